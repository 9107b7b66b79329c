import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talkprint.functions import text as T
from talkprint.functions.banks import ACKNOWLEDGMENTS, BANKS, DIMENSIONS, FEATURES
from talkprint.operators.fingerprint import BLOCK, fingerprint, individual_fingerprints, repeating_turns


def user(*texts):
    return [("user", t) for t in texts]


EDGE = {
    "terse": [("assistant", "What is your order id?"), ("user", "123"), ("assistant", "Thanks."), ("user", "ok")],
    "verbose": [("assistant", "Your id?"), ("user", "Sure, my order id is 123 and I wanted to add that I need help.")],
    "polite": user("Please help me, thank you."),
    "blunt": user("Fix my order now."),
    "agent only": [("assistant", "Hello, please thanks")],
    "blank": [("user", ""), ("user", "   "), ("user", None), ("user", "a b c d")],
    "single": user("hello there"),
    "dots": user("..."),
    "three": user("a b c"),
    "four": user("a b c d"),
    "growing": user("a b", "a b c d", "a b c d e f"),
    "gram x3": user(*["buy it now"] * 3),
    "gram x4": user(*["buy it now"] * 4),
    "gram inside": user("a b c a b c a b c a b c", "x"),
    "gram across": user(*["a b", "c a"] * 6),
}
TEXTS = {
    "acknowledgment_rate": {" OK.": 1, "ok!!!": 1, "ok then": 0, "Sounds good,": 1, "\u3000yes\n": 1},
    "words_per_turn": {"ély ly": 2, "naïve—yes": 2, "élyé": 1},
    "accusatory_rate": {"ély ly": 1, "naïve—yes": 0, "élyé": 0},
    "clarification_question_rate": {"what?": 1, "what?\n": 1, "what?\r\n": 0, "what? no": 0},
    "identifiers_per_turn": {
        "#AB12C": 1, "ABC123 and 1234567 a@b.co x@y.zz": 4, "abc12": 0, "ABCDEF@x.y": 1, "ABCDEF,x@y.z": 2, "@a.b": 0, "@a@b.c": 1,
    },
}


def one(turns, messages, **kw):
    return fingerprint(turns({"d": messages}), **kw).first().asDict()


@pytest.fixture(scope="module")
def edge(spark):
    dialogs = dict(EDGE) | {t: user(t) for texts in TEXTS.values() for t in texts}
    rows = [(d, i, r, c) for d, ms in dialogs.items() for i, (r, c) in enumerate(ms)]
    df = spark.createDataFrame(rows, "dialog_id string, turn long, role string, content string")
    return {r.dialog_id: r for r in fingerprint(df).collect()}


def test_names_and_dimensions():
    assert len(FEATURES) == 19 and [len(v) for v in DIMENSIONS.values()] == [8, 3, 5, 3]
    assert set(BANKS) <= set(FEATURES) and len(BANKS) == 11


def test_terse_is_shorter_than_verbose(edge):
    assert edge["terse"].words_per_turn == 1.0 < edge["verbose"].words_per_turn


def test_polite_beats_blunt(edge):
    assert edge["polite"].politeness_rate == 1.0 and edge["blunt"].politeness_rate == 0.0


def test_no_user_turn_gives_zeros(edge):
    row = edge["agent only"]
    assert all(row[f] == 0.0 for f in FEATURES) and row.n_messages == 1


def test_empty_is_no_turn_but_blank_is(edge):
    row = edge["blank"]
    assert (row.words_per_turn, row.short_utterance_rate, row.opening_length) == (2.0, 0.5, 0.0)


def test_single_turns(edge):
    assert edge["single"].front_loading_ratio == 1.0
    assert edge["dots"].front_loading_ratio == 0.0 and edge["dots"].verbosity_cv == 0.0


def test_short_boundary(edge):
    assert edge["three"].short_utterance_rate == 1.0 and edge["four"].short_utterance_rate == 0.0


def test_verbosity_and_front_loading(edge):
    row = edge["growing"]
    assert row.verbosity_cv == pytest.approx((8 / 3) ** 0.5 / 4) and row.front_loading_ratio == 0.5


def test_trigrams(edge):
    got = [edge[k].repetition_rate for k in ("gram x3", "gram x4", "gram inside", "gram across")]
    assert got == [0.0, 1.0, 0.5, 0.0]


@pytest.mark.parametrize("feature", TEXTS)
def test_single_texts(edge, feature):
    assert {t: edge[t][feature] for t in TEXTS[feature]} == TEXTS[feature]


def brute_repeating(texts):
    toks = [re.findall(r"\b\w+\b", t.lower()) for t in texts]
    counts = Counter(g for t in toks for g in zip(t, t[1:], t[2:]))
    hot = {g for g, c in counts.items() if c > 3}
    return sum(any(g in hot for g in zip(t, t[1:], t[2:])) for t in toks)


def test_repetition_over_many_blocks(turns):
    """Dialogues shorter and much longer than a block, against a brute-force count."""
    rnd = random.Random(3)
    dialogs = {
        f"d{k}": [("user", " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 4)))) for _ in range(n)]
        for k, n in enumerate([1, 5, BLOCK, BLOCK + 1, 5 * BLOCK + 7, 40])
    }
    got = {r.dialog_id: r.n_repeating for r in repeating_turns(turns(dialogs)).collect()}
    want = {d: brute_repeating([c for _, c in ms if c]) for d, ms in dialogs.items()}
    assert got == {d: n for d, n in want.items() if n}
    assert max(want.values()) > BLOCK


def test_role_and_banks_are_parameters(turns):
    d = [("agent", "refund please"), ("user", "no")]
    assert one(turns, d, role="agent")["politeness_rate"] == 1.0
    row = one(turns, d, role="agent", banks={"refund_rate": [r"\brefund\b"]}, features=["refund_rate", "words_per_turn"])
    assert row == {"dialog_id": "d", "n_messages": 2, "refund_rate": 1.0, "words_per_turn": 2.0}


def test_individual_needs_two_messages(turns):
    fps = fingerprint(turns({"a": [("user", "hi")], "b": [("user", "hi"), ("assistant", "yo")]}))
    assert [r.dialog_id for r in individual_fingerprints(fps).collect()] == ["b"]


def sample(pattern, rnd):
    """A text the pattern describes."""
    p = pattern.replace(r"\b", "").replace("$", "").replace(r"\s*", " ").replace("[- ]?", "-")

    def pick(m):
        return rnd.choice(m.group(1).split("|")) if not m.group(2) or rnd.random() < 0.5 else ""

    while "(?:" in p:
        p = re.sub(r"\(\?:([^()]*)\)(\??)", pick, p)
    p = p.replace(r"\?", "?" if rnd.random() < 0.5 else "")
    p = re.sub(r"(.)\?", lambda m: m.group(1) if rnd.random() < 0.5 else "", p)
    return re.sub(r"(.)\+", lambda m: m.group(1) * rnd.randint(1, 3), p)


def test_expressions_match_plain_regex_semantics(spark):
    """Every bank, token count, identifier count and trim against Python's re."""
    rnd = random.Random(11)
    before = ["", "é", "é ", "_", "x", " ", "\n", "-", "½", "1", "("]
    after = ["", "é", " é", "_", "s", " ", "\n", "\r\n", "\n\n", "?", "., ", ",x", "²", "'"]
    texts = [
        rnd.choice(before) + sample(p, rnd) + rnd.choice(after) for ps in BANKS.values() for p in ps for _ in range(8)
    ]
    texts += [rnd.choice(["", " ", "\x1c"]) + rnd.choice([a, a.upper()]) + rnd.choice(["", ".", "!!,", "\x85", " x"]) for a in ACKNOWLEDGMENTS]
    texts += ["".join(rnd.choice("#AB1Z9 @.x@.é٣\n") for _ in range(rnd.randint(1, 24))) for _ in range(800)]
    low = F.lower("t")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", F.size(T.tokens(low)).alias("tokens"), T.matches_whole(low, ACKNOWLEDGMENTS).alias("ack"),
        T.identifier_count(F.col("t")).alias("ids"), T.trim_ws(F.col("t")).alias("trim"), T.is_blank(F.col("t")).alias("blank"),
        *[T.matches_bank(low, v).alias(k) for k, v in BANKS.items()],
    ).collect()
    ids = re.compile(r"#[A-Z0-9]{5,}|[A-Z0-9]{6,}|\b\d{7,}\b|\S+@\S+\.\S+")
    ack = "(?:" + "|".join(ACKNOWLEDGMENTS) + r")[.!,]*"
    for r in rows:
        t, lo = texts[r.i], texts[r.i].lower()
        assert r.tokens == len(re.findall(r"\b\w+\b", lo)), t
        assert r.ack == bool(re.fullmatch(ack, t.strip().lower())), t
        assert r.ids == len(ids.findall(t)), t
        assert r.trim == t.strip() and r.blank == (not t.strip()), t
        for k, v in BANKS.items():
            assert r[k] == any(re.search(p, lo) for p in v), (k, t)


def test_hot_dialogue_keeps_no_window_over_it(turns):
    """The opening turns are pruned before the shuffle and nothing else sorts a dialogue."""
    plan = fingerprint(turns({"d": [("user", "a b c")]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == plan.count("WindowGroupLimit [dialog_id#") // 2


AWKWARD = [
    r"\b(?:very )?good\b", "foo|bar", r"\bfoo\b|\bbar\b", r"\$\d+", r"[$.]\s*x", r"\bx?yz\b", r"\b(?:a|bc)d\b", r"\b(?:(?:un)?done|ok)\b",
    r"^\s*hi\b", r"end$", r"\w+@\w+", r"[^\W\d]+\d", r"[]a]q", r"[[&]z", r"(ab)\1", r"(?P<c>[xy])-(?P=c)", r"\bgo+d\b", r"\(a\|b\)", r"a.c", r"\bé\b",
]
SAMPLES = [
    "good", "very good", "goods", "foo", "a bar", "foobar", "cost $15", "$ 15", ". x", "$\u3000x", "yz", "xyz", "ad", "bcd", "abd", "undone", "done", "ok",
    " hi there", "oh hi", "the end", "the end\n", "ending", "a@b", "é1", "1a", "]q", "aq", "&z", "[z", "abab", "abba", "x-x", "x-y", "god", "gooood", "gd",
    "(a|b)", "a\nc", "a\rc", "é", "né", "", "٣ $٣",
]


@pytest.mark.parametrize("bank", [[p] for p in AWKWARD] + [AWKWARD[:8], AWKWARD], ids=str)
def test_custom_banks_match_as_python_does(spark, bank):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string").select("s", T.matches_bank(F.col("s"), bank).alias("hit"))
    assert {r.s: r.hit for r in df.collect()} == {s: any(re.search(p, s) for p in bank) for s in SAMPLES}


def test_repetition_reads_turns_twice_and_moves_text_once(turns, monkeypatch):
    from talkprint.operators import fingerprint as module

    plans = []
    monkeypatch.setattr(module, "settle", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    df = turns({"a": [("user", "x y z")] * 3})
    repeating_turns(df)
    assert plans[0].count("LogicalRDD") + plans[0].count("LocalRelation") == 2 and plans[0].count("RepartitionByExpression") == 1
