"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a sequence once in each direction, gives
every position a distribution over the languages from both states, and a
document pools the distributions of all its positions.  It is trained here, in
numpy, by backpropagation through time.

A sequence is a lower-cased run of letters with a blank at each end; runs are
cut after ``MAX_BYTES`` bytes so that text without spaces stays bounded.
States start afresh at each sequence.  That makes the labels of a word a
function of the word alone, so a Python worker labels a word once and keeps its
summed distribution in a bounded cache; the whole text still counts, position
by position.
"""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkprint.llm.common import map_batches

UNKNOWN = "und"
MAX_BYTES = 32
NOT_LETTERS = re.compile(r"[\W\d_]+")
CACHE_WORDS = 200_000
CHUNK_CHARS = 500_000


def sequences(text: str) -> list[str]:
    """Lower-cased letter runs of a whole text."""
    return NOT_LETTERS.sub(" ", text.lower()).split()


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def _bytes(word: str) -> list[bytes]:
    data = word.encode("utf-8", "replace")
    return [b" " + data[i:i + MAX_BYTES] + b" " for i in range(0, len(data), MAX_BYTES)]


def _padded(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time x batch) byte codes and the mask of real positions."""
    size = np.array([len(s) for s in seqs])
    steps = int(size.max())
    codes = np.frombuffer(b"".join(s.ljust(steps) for s in seqs), np.uint8).reshape(len(seqs), steps).T
    return codes, (np.arange(steps)[:, None] < size[None, :]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class ByteGRU:
    """Weights: per direction input rows ``x`` (a row per byte), state matrix ``u`` and bias ``b``; output ``wo``, ``bo``."""

    def __init__(self, labels: list[str], hidden: int = 16, seed: int = 7):
        self.labels, self.hidden = list(labels), hidden
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w["x" + d] = draw(256, 3 * hidden, scale=0.3)
            self.w["u" + d] = draw(hidden, 3 * hidden, scale=hidden**-0.5)
            self.w["b" + d] = np.zeros(3 * hidden, np.float32)
        self.w["wo"] = draw(2 * hidden, len(labels), scale=0.3)
        self.w["bo"] = np.zeros(len(labels), np.float32)

    def _run(self, d: str, codes: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States after each position in direction ``d``; with ``keep`` also what the backward pass needs."""
        n = self.hidden
        u, given = self.w["u" + d], self.w["x" + d][codes] + self.w["b" + d]
        states = np.zeros((*codes.shape, n), np.float32)
        h, tape = np.zeros((codes.shape[1], n), np.float32), []
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            inner, m = h @ u, mask[t][:, None]
            gates = _sigmoid(given[t, :, :2 * n] + inner[:, :2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(given[t, :, 2 * n:] + r * inner[:, 2 * n:])
            new = h + m * (1 - z) * (c - h)
            if keep:
                tape.append((t, h, z, r, c, inner[:, 2 * n:], m))
            states[t] = h = new
        return states, tape

    def positions(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Distribution over the languages at every position (time x batch x labels)."""
        both = np.concatenate([self._run("f", codes, mask)[0], self._run("b", codes, mask)[0]], -1)
        return _softmax(both @ self.w["wo"] + self.w["bo"])

    def pooled(self, words: list[str], batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Per word the sum of its positions' distributions, and the number of positions."""
        parts = [(i, s) for i, w in enumerate(words) for s in _bytes(w)]
        parts.sort(key=lambda p: len(p[1]))
        total, size = np.zeros((len(words), len(self.labels))), np.zeros(len(words))
        for at in range(0, len(parts), batch):
            some = parts[at:at + batch]
            codes, mask = _padded([s for _, s in some])
            summed = (self.positions(codes, mask) * mask[:, :, None]).sum(0)
            owner = np.array([i for i, _ in some])
            np.add.at(total, owner, summed)
            np.add.at(size, owner, mask.sum(0))
        return total, size

    def gradients(self, codes: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over real positions and its gradients, by backpropagation through time."""
        n, g = self.hidden, {k: np.zeros_like(v) for k, v in self.w.items()}
        runs = {d: self._run(d, codes, mask, keep=True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], -1)
        p = _softmax(both @ self.w["wo"] + self.w["bo"])
        count = mask.sum()
        hit = np.take_along_axis(p, np.broadcast_to(target[None, :, None], (*codes.shape, 1)), -1)[..., 0]
        loss = float(-(np.log(hit + 1e-9) * mask).sum() / count)
        dy = p.copy()
        dy[:, np.arange(len(target)), target] -= 1
        dy *= mask[:, :, None] / count
        flat = dy.reshape(-1, dy.shape[-1])
        g["wo"], g["bo"] = both.reshape(-1, 2 * n).T @ flat, flat.sum(0)
        dboth = dy @ self.w["wo"].T
        for d, part in (("f", dboth[..., :n]), ("b", dboth[..., n:])):
            u, dh = self.w["u" + d], np.zeros((codes.shape[1], n), np.float32)
            dgiven = np.zeros((*codes.shape, 3 * n), np.float32)
            for t, h, z, r, c, inner, m in reversed(runs[d][1]):
                dh = dh + part[t]
                dnew = dh * m
                dc = dnew * (1 - z) * (1 - c * c)
                da = np.concatenate([dnew * (h - c) * z * (1 - z), dc * inner * r * (1 - r), dc], 1)
                du = np.concatenate([da[:, :2 * n], dc * r], 1)
                dgiven[t] = da
                g["u" + d] += h.T @ du
                dh = dh * (1 - m) + dnew * z + du @ u.T
            np.add.at(g["x" + d], codes.reshape(-1), dgiven.reshape(-1, 3 * n))
            g["b" + d] = dgiven.sum((0, 1))
        return loss, g

    def fit(self, words: list[str], target: np.ndarray, steps: int = 400, batch: int = 384, rate: float = 0.01, seed: int = 11):
        """Adam over random batches of words."""
        rng, first, second = np.random.default_rng(seed), {}, {}
        pairs = [(s, y) for w, y in zip(words, target, strict=True) for s in _bytes(w)]
        for step in range(1, steps + 1):
            some = [pairs[i] for i in rng.integers(0, len(pairs), batch)]
            codes, mask = _padded([s for s, _ in some])
            _, g = self.gradients(codes, mask, np.array([y for _, y in some]))
            decay = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                first[k] = 0.9 * first.get(k, 0) + 0.1 * v
                second[k] = 0.99 * second.get(k, 0) + 0.01 * v * v
                self.w[k] = (
                    self.w[k] - decay * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                ).astype(np.float32)
        return self


def training_words(
    docs: DataFrame, per_label: int, words_per_doc: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"
) -> list[tuple[str, list[str]]]:
    """A bounded sample: up to ``per_label`` documents of each label, ``words_per_doc`` words from anywhere in each."""
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    chosen = (
        docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), order.alias("o"))
        .withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("o", F.col(id_col))))
        .where(F.col("place") <= per_label)
    )

    def run(batches):
        for b in batches:
            out = []
            for t in b["text"]:
                words = sequences(t)
                rng = np.random.default_rng(zlib.crc32(t.encode("utf-8", "replace")))
                out.append([words[i] for i in rng.integers(0, len(words), words_per_doc)] if words else [])
            yield [b["label"], out]

    rows = map_batches(chosen.select("label", "text"), run, "label string, words array<string>").collect()
    return sorted((r.label, list(r.words)) for r in rows)


def train(
    docs: DataFrame, per_label: int = 200, words_per_doc: int = 120, hidden: int = 16, steps: int = 400,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
) -> ByteGRU | None:
    """Fit on a bounded sample of labelled rows (``per_label`` x ``words_per_doc`` words of each label).

    None if no labelled row has a letter.
    """
    sample = [(y, w) for y, ws in training_words(docs, per_label, words_per_doc, id_col, text_col, label_col) for w in ws]
    labels = sorted({y for y, _ in sample})
    if not labels:
        return None
    return ByteGRU(labels, hidden).fit([w for _, w in sample], np.array([labels.index(y) for y, _ in sample]), steps)


class _Pooler:
    """Document distributions, with the words of one worker kept in a bounded table."""

    def __init__(self, model: ByteGRU):
        self.model, self.row, self.table = model, {}, np.zeros((0, len(model.labels) + 1))

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        counts = [Counter(sequences(t)) for t in texts]
        new = list({w for c in counts for w in c if w not in self.row})
        if len(self.row) + len(new) > CACHE_WORDS:
            self.row, self.table = {}, self.table[:0]
            new = list({w for c in counts for w in c})
        if new:
            self.row.update({w: len(self.table) + i for i, w in enumerate(new)})
            total, size = self.model.pooled(new)
            self.table = np.concatenate([self.table, np.column_stack([total, size])])
        out = []
        for c in counts:
            if not c or not has_letter(list(c)):
                out.append((UNKNOWN, 0.0))
                continue
            rows = np.fromiter(map(self.row.__getitem__, c), np.int64, len(c))
            summed = np.fromiter(c.values(), np.float64, len(c)) @ self.table[rows]
            p = summed[:-1] / summed[-1]
            best = int(p.argmax())
            out.append((self.model.labels[best], float(min(1.0, max(0.0, p[best])))))
        return out


def predict(
    docs: DataFrame, model: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (),
    out: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``lang_pred`` and ``score`` (or the names in ``out``) of every whole text, next to the columns of ``keep``.

    The label with the largest pooled probability wins, the first in label
    order on ties.  Null text, text without a letter, or no model: ``und``, 0.
    A map over the rows; only the text decides.
    """
    kept = list(dict.fromkeys((id_col, *keep)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches):
        pooler = _Pooler(model) if model else None
        for b in batches:
            texts, at, found = [t or "" for t in b[text_col]], 0, []
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < CHUNK_CHARS or end == at):
                    size += len(texts[end])
                    end += 1
                found += pooler.documents(texts[at:end]) if pooler else [(UNKNOWN, 0.0)] * (end - at)
                at = end
            yield [*(b[k] for k in kept), [y for y, _ in found], [s for _, s in found]]

    read = docs.select(*dict.fromkeys((*kept, text_col)))
    return map_batches(read, run, f"{fields}, `{out[0]}` string, `{out[1]}` double")


def held_out(id_col: str = "doc_id"):
    """Rows whose id the contract keeps from training: remainder 2 of its checksum by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
