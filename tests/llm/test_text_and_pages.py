"""Language identification, fingerprints, page extraction, archives."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from talkprint.llm import extract, language, syncmers, warc
from tests.conftest import SF

# ------------------------------------------------------------------ language


def test_gradients_are_those_of_the_loss():
    net = language.ByteGRU(["a", "b", "c"], 3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    codes, mask = language._padded([b" ab ", b" xyzz "])
    target = np.array([0, 2])
    _, grads = net.gradients(codes, mask, target)
    for name, w in net.w.items():
        at = (97, 1) if name[0] == "x" else (0,) * w.ndim
        step = np.zeros_like(w)
        step[at] = 1e-3
        both = []
        for sign in (1, -1):
            net.w[name] = w + sign * step
            both.append(net.gradients(codes, mask, target)[0])
        net.w[name] = w
        assert grads[name][at] == pytest.approx((both[0] - both[1]) / 2e-3, rel=1e-2, abs=1e-6)


def test_padding_changes_nothing():
    net = language.ByteGRU(["a", "b"], 4)
    together, n = net.pooled(["ab", "abcdefgh", "漢字"])
    for i, w in enumerate(["ab", "abcdefgh", "漢字"]):
        alone, m = net.pooled([w])
        assert together[i] == pytest.approx(alone[0], rel=1e-4) and n[i] == m[0]
    assert net.pooled(["x" * 100])[1][0] == 100 + 2 * 4  # cut into four sequences with a blank at each end


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, language.train(docs.where(~language.held_out()), steps=250)


def test_held_out_accuracy(trained):
    docs, model = trained
    rows = language.predict(docs, model, keep=("lang",)).where(language.held_out()).collect()
    assert len(rows) > 30 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark, trained):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !? ½", "x"), (None, "the and of", "x"), (5, "漢字", "x"), (6, "the " * 200_000, "x")]
    df = spark.createDataFrame([(*r, "y", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in language.predict(df, trained[1]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0
    assert got[5].lang_pred in trained[1].labels and got[6].lang_pred == "en"
    assert language.predict(df.limit(0), trained[1]).count() == 0


def test_the_cache_of_words_is_bounded(trained, monkeypatch):
    texts = ["the house of ages", "la maison des arbres", "the other house"]
    want = language._Pooler(trained[1]).documents(texts)
    monkeypatch.setattr(language, "CACHE_WORDS", 3)
    small = language._Pooler(trained[1])
    assert [small.documents([t])[0][0] for t in texts] == [y for y, _ in want]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language.train(df)
    assert model is None and {r.lang_pred for r in language.predict(df, model).collect()} == {"und"}


# ------------------------------------------------------------------ syncmers


def brute_syncmers(data):
    view = [int(x) for x in syncmers._mixed(np.array([int.from_bytes(data[i:i + 8], "little") for i in range(len(data) - 7)], np.uint64))]
    return [i for i in range(len(data) - syncmers.K + 1) if min(view[i:i + syncmers.SPAN]) in (view[i], view[i + syncmers.SPAN - 1])]


def test_anchors_are_closed_syncmers_and_free_of_context():
    rng = random.Random(0)
    data = bytes(rng.randrange(97, 122) for _ in range(600))
    at, h = syncmers.anchors(data)
    assert at.tolist() == brute_syncmers(data)
    assert max(np.diff(at)) <= syncmers.SPAN
    moved_at, moved = syncmers.anchors(b"prefix" + data[100:400] + b"suffix")
    inside = [(i - 6 + 100, x) for i, x in zip(moved_at.tolist(), moved.tolist()) if 6 <= i <= 306 - syncmers.K]
    assert inside == [(i, x) for i, x in zip(at.tolist(), h.tolist()) if 100 <= i <= 400 - syncmers.K]


def test_sketch_is_the_smallest_hashes():
    data = bytes(random.Random(1).randrange(97, 122) for _ in range(30_000))
    every = np.unique((syncmers.anchors(data)[1] >> np.uint64(32)).astype(np.uint32))
    assert syncmers.sketch(data).tolist() == every[: syncmers.SKETCH].tolist()
    assert syncmers.parsed(syncmers.written(every[:5])).tolist() == every[:5].tolist()
    assert len(syncmers.sketch(b"a" * 100_000)) == 1 and len(syncmers.sketch(b"")) == 0


def test_likeness():
    a, b = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4, 5], np.uint32)
    none = np.zeros(0, np.uint32)
    assert syncmers.likeness(a, b) == pytest.approx(2 / 5) and syncmers.likeness(a, a) == 1.0
    assert syncmers.likeness(none, none) == 1.0 and syncmers.likeness(a, none) == 0.0


def brute_study(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = t or "", n or ""
        own, other, following = (syncmers.sketch(x.encode()) for x in (t, syncmers.edited(t, n), n))
        digest = hashlib.sha256(syncmers.edited(t, n).encode()).hexdigest()
        out.append((i, len(t), digest, syncmers.written(own), syncmers.written(other), syncmers.likeness(own, other), syncmers.likeness(own, following)))
    return out


def test_every_row_meets_the_next(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(0, 400)))) for _ in range(200)]
    rows += [(None, None), (None, "no id"), (5, "same id b"), (5, "same id a"), (5, "same id a"), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, piece int, ghost string, id string")
    got = [tuple(r) for r in syncmers.edit_study(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_study(rows)))


def test_study_of_no_and_one_row(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert syncmers.edit_study(empty).count() == 0
    one = syncmers.edit_study(spark.createDataFrame([(3, "abcdef" * 9)], empty.schema)).first()
    assert one.near_next == 1.0 and one.n_chars == 54


def test_anchor_and_fingerprint_tables(spark):
    df = spark.createDataFrame([(1, "a text that is long enough to have anchors"), (2, None)], "doc_id long, text string")
    table = syncmers.anchor_table(df).collect()
    assert {r.doc_id for r in table} == {1}
    prints = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(df).collect()}
    assert prints[2] == "" and len(prints[1]) % 8 == 0 and prints[1]


# ------------------------------------------------------------------ pages

ARTICLE = "<p>First sentence of it, with a comma. Second one follows.</p><p>Another paragraph; longer still, and it ends here.</p>"
TEXT = "First sentence of it, with a comma. Second one follows. Another paragraph; longer still, and it ends here."


@pytest.mark.parametrize("page", [
    f"<html><body><nav><a href=x>Home</a></nav><article>{ARTICLE}</article><footer>&copy; us</footer></body></html>",
    f"<body><div class='menu'>Home, About.</div><div id=content>{ARTICLE}</div><div class='sidebar'><p>Read this, too.</p></div>",
    f"<div class='cookie-notice'>We use cookies, yes.</div><main>{ARTICLE}</main><section id='comments'><p>Nice, I think. So.</p></section>",
    f"<script>var a = '<p>no</p>';</script><style>p{{}}</style><div>{ARTICLE}</div><form><p>Your name, please.</p></form>",
    f"<HTML><BODY><!-- ad <p>x</p> --><DIV CLASS='has-sidebar'>{ARTICLE}<aside>More, here.</aside></DIV>",
    f"<div class=post>{ARTICLE.replace('</p>', '')}</div>",
])
def test_article_only(page):
    assert extract.main_text(page) == TEXT


def test_text_details():
    page = "<article><h1>A &amp; B</h1><p>One\n  <b>bo</b>ld&nbsp;word, &lt;tag&gt;.<br>Next line, here.</p><ul><li>item one</li><li>item two</li></ul></article>"
    assert extract.main_text(page) == "A & B One bold word, <tag>. Next line, here. item one item two"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<p> </p>") == extract.main_text("<script>x") == ""
    assert extract.main_text("no markup at all, here") == "no markup at all, here"


def test_very_long_and_broken_pages_end():
    assert extract.main_text("<p>" * 20_000 + "deep, text.") == "deep, text."
    assert extract.main_text("<a title='" + "x" * 200_000) != ""
    assert extract.main_text("<article>" + "<p>Some words, again. </p>" * 20_000) == " ".join(["Some words, again."] * 20_000)


@pytest.mark.parametrize(("inner", "want"), [
    (f"<section id='discussion'><h2 id='social-effects'>Effects</h2>{ARTICLE}</section>", f"Effects {TEXT}"),
    (f"<h2 id='related-work'>Earlier</h2><div class='legal-text'>{ARTICLE}</div><section id='market-share'><p>It fell.</p></section>", f"Earlier {TEXT} It fell."),
    (f"{ARTICLE}<figure><img src=x><figcaption>A figure</figcaption></figure><ol><li><a href=x>A reference of 1999</a></li></ol>", f"{TEXT} A figure A reference of 1999"),
    (f"<h1>Title</h1><div>{ARTICLE}</div>", f"Title {TEXT}"),
    (f"{ARTICLE}<div class='ad-slot'><p>Buy, now.</p></div><ul class='share-buttons'><li>Mail</li></ul><div id='newsletter'><p>Join.</p></div>"
     "<div class='related-posts'><p>Read on.</p></div><section id='comments'><p>Nice, I think. So.</p></section>", TEXT),
])
def test_names_inside_an_article_do_not_rule_text_out(inner, want):
    assert extract.main_text(f"<body><nav>Home</nav><article>{inner}</article><footer>us</footer></body>") == want


def generated_page(rng: random.Random, tag: str) -> tuple[str, str]:
    """A page of a known article in a ``tag`` and of everything that is to go."""
    sentence = lambda n: " ".join(rng.choice("the of and text word long some page".split()) for _ in range(n)).capitalize()
    paragraph = lambda: " ".join(f"{sentence(rng.randint(5, 20))}, {sentence(3).lower()}." for _ in range(rng.randint(1, 6)))
    title, texts = sentence(6), [paragraph() for _ in range(rng.randint(3, 30))]
    menu = "".join(f"<li><a href=/{i}>{sentence(1)}</a></li>" for i in range(rng.randint(3, 12)))
    page = (
        f"<html><body><div><ul>{menu}</ul></div><div class=box7><span>{sentence(3)}</span></div>"
        f"<{tag}><h1>{title}</h1>{''.join(f'<p>{t}</p>' for t in texts)}</{tag}>"
        f"<div class=box8><span>{sentence(4)}</span></div><div class=sidebar><p>{paragraph()}</p></div><footer>{sentence(5)}</footer></body></html>"
    )
    return page, " ".join([title, *texts])


@pytest.mark.parametrize("tag", ["article", "main", "div", "section class=x1"])
def test_generated_pages_give_their_article(tag):
    rng = random.Random(11)
    for _ in range(60):
        page, want = generated_page(rng, tag)
        assert extract.main_text(page.replace("</section class=x1>", "</section>")) == want


def test_the_ratios_decide(monkeypatch):
    page, want = generated_page(random.Random(3), "article")
    assert extract.main_text(page) == want
    # Text outside of a nearly empty article is found by its ratios.
    assert TEXT in extract.main_text(f"<article><span>Ad</span></article><div>{ARTICLE * 20}</div>")
    monkeypatch.setattr(extract, "content_paths", lambda *_, **__: set())
    assert extract.main_text(page) == ""


def test_comments_inside_an_article_go():
    assert extract.main_text(f"<article>{ARTICLE}<article class='comment'><p>Nice, I think. So.</p></article></article>") == TEXT


def test_headings_of_main_are_content():
    assert extract.main_text(f"<main><h1 id='social-notice'>Title</h1><div>{ARTICLE}</div></main>") == f"Title {TEXT}"


def test_path_ratios_choose_the_punctuated_path():
    blocks = extract.blocks("<div><span>menu</span></div><div class=a><p>Long text, with marks. And more, of it.</p><p>Also long, also marked, yes.</p></div><div>x</div>")
    assert {p[-1] for p in extract.content_paths(blocks)} == {("p",)}


def test_extract_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (None, None, None, "x"), (1, "u", f"<article>{ARTICLE}</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.text, r.n_chars, r.url) if r.url else ("", r.n_chars, "") for r in extract.extract(df).collect())
    assert got == [("", 0, ""), (TEXT, len(TEXT), "u"), (TEXT, len(TEXT), "u")] and extract.extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------ archives

PAGES = [
    (5, "http://a/x y\r\n", "é" * 100), (3, "http://b", "é" * 100), (4, "http://b", "é" * 100), (9, None, None), (8, "c", ""),
    (1, "d", "short"), (2, "d", "short"), (None, "e", "é" * 100), (3, "http://b", "é" * 100), (6, "f", "WARC/1.1\r\n\r\n" * 2000), (7, "g", "z" * 3_000_000),
]


def brute_archive(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in data:
        ids = [j for j, q in data if q == p and j is not None]
        first = min(ids) if ids and len(p) >= 100 else None
        again = first is not None and i != first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(map(repr, out))


def pages_df(spark):
    rows = [(*r, "x", 1) for r in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, archive string, place int")


def test_round_trip_equals_brute_force(spark, tmp_path):
    got = warc.round_trip(pages_df(spark), str(tmp_path / "w"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_archive(PAGES)
    assert warc.round_trip(pages_df(spark).limit(0), str(tmp_path / "none")).count() == 0


def test_archives_are_one_member_per_record_and_indexed(spark, tmp_path, monkeypatch):
    files = warc.archive_pages(pages_df(spark).coalesce(1), str(tmp_path / "w")).collect()
    assert sum(f.records for f in files) == len(PAGES)
    for f in files:
        whole = gzip.open(f.archive).read()
        assert whole.count(b"WARC-Type: ") == f.records and whole.startswith(b"WARC/1.1\r\n")
        at = 0
        raw = open(f.archive, "rb").read()
        for line in open(f.sidecar, "rb").read().splitlines():
            offset, length, kind, rid = line.split(b"\t")
            record = gzip.decompress(raw[int(offset):int(offset) + int(length)])
            assert int(offset) == at and rid in record and b"WARC-Type: " + kind in record
            at += int(length)
        assert at == len(raw)


def test_a_member_is_reached_by_its_offset(spark, tmp_path):
    f = warc.archive_pages(pages_df(spark).coalesce(1), str(tmp_path / "w")).first()
    line = open(f.sidecar, "rb").read().splitlines()[-1].split(b"\t")
    with fs.LocalFileSystem().open_input_file(f.archive) as source:
        fields, block = warc.fetch(source, int(line[0]), int(line[1]))
    assert fields[b"warc-record-id"] == line[3] and block.startswith(b"HTTP/1.1 200 OK")


def test_truncated_and_foreign_archives_fail(spark, tmp_path):
    good = gzip.compress(warc.response(1, "u", b"payload", b"0"))
    for name, data in (("cut", good[:-20]), ("foreign", gzip.compress(b"hello\r\n\r\n"))):
        (tmp_path / name).write_bytes(data)
        files = spark.createDataFrame([(str(tmp_path / name), None)], "archive string, changes array<struct<place:long,refers_to:long>>")
        with pytest.raises(Exception, match="ends|starts with"):
            warc.normalise(files, str(tmp_path / "out")).collect()


def test_multi_member_input_is_read_too(spark, tmp_path):
    data = b"".join(gzip.compress(warc.response(i, "u", b"x" * i, hashlib.sha256(b"x" * i).hexdigest().encode())) for i in (1, 2))
    (tmp_path / "two").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "two"), None)], "archive string, changes array<struct<place:long,refers_to:long>>")
    back = warc.read_indexed(warc.normalise(files, str(tmp_path / "out"))).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in back) == [(1, 1), (2, 2)]


def test_small_files_are_cut(spark, tmp_path, monkeypatch):
    rows = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("ab"), 500).alias("html")).coalesce(1)
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    records = warc.write_monolithic(rows, str(tmp_path / "m"))
    assert records.count() == 50
