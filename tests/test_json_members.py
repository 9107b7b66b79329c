"""JSON files of one value each, cut at any byte by the scan."""

import json
import random

import pytest

from talkprint.sources import dialogs as D
from talkprint.sources.json_members import events, read_array, read_members, read_object


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that records, strings and keys lie across them."""
    names = {"spark.sql.files.maxPartitionBytes": "200b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.5:
        return rng.choice(["", 'a"b', "x\\", "}{", "[,]", '\\"}', 5, None, True, "é漢" * 9, "long " * 30, 1.5])
    if kind < 0.75:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice('ab"\\}') + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def as_python(df, *columns):
    rows = df.selectExpr(*columns, "to_json(v) AS v").collect()
    return [(*r[:-1], None if r.v is None else json.loads(r.v)) for r in rows]


def test_array_records_keep_their_places(small_ranges, tmp_path):
    rng = random.Random(3)
    want = {}
    for name, indent, n in (("a.json", None, 60), ("b.json", 2, 40), ("c.json", None, 1), ("d.json", None, 0), ("e.json", 1, 25)):
        data = [value(rng) for _ in range(n)]
        want |= {(name, i): v for i, v in enumerate(data)}
        text = json.dumps(data, indent=indent, ensure_ascii=name == "a.json")
        (tmp_path / name).write_text(" \n" + text + "\n" * (n % 2), encoding="utf-8")
    found = read_members(small_ranges, str(tmp_path), "array")
    assert len({r.path for r in found.select("path").collect()}) == 4
    assert {(f, i): v for f, i, v in as_python(read_array(small_ranges, str(tmp_path)), "file", "i")} == want


def test_an_array_is_read_by_many_tasks(small_ranges, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"k": i, "t": "word " * 20} for i in range(200)]))
    from talkprint.sources.json_members import _scan

    scan = _scan(small_ranges, str(tmp_path))
    assert scan.rdd.getNumPartitions() > 50 and scan.select("block").distinct().count() > 50
    assert [v["k"] for _, v in sorted(as_python(read_array(small_ranges, str(tmp_path)), "i"))] == list(range(200))


def test_object_keys(small_ranges, tmp_path):
    rng = random.Random(4)
    data = {f'k"{i}\\' if i % 3 else f"clé {i}": value(rng) for i in range(50)}
    (tmp_path / "o.json").write_text(json.dumps(data))
    text = json.dumps(data)[:-1] + ', "clé 3": "later", "\\u0063l\\u00e9 6": [1]}\n'
    (tmp_path / "p.json").write_text(text, encoding="utf-8")
    (tmp_path / "q.json").write_text("{ }")
    got = {}
    for f, key, v in as_python(read_object(small_ranges, str(tmp_path)), "file", "key"):
        assert (f, key) not in got
        got[f, key] = v
    assert got == {("o.json", k): v for k, v in data.items()} | {("p.json", k): v for k, v in json.loads(text).items()}


@pytest.mark.parametrize("text", ['{"a": 1}', "3", "[1] [2]", "[1]" + " " * 500 + "[2]", "x [1]", '[{"a": 1}', '[{"a": "x}]', "[1, 2]]", '[{"a": 1}] x', "[1,,2]", "[1, 2,]", '[{"a": }]'])
def test_malformed_arrays_raise(small_ranges, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    (tmp_path / "good.json").write_text("[1, 2]")
    with pytest.raises(Exception):
        read_array(small_ranges, str(tmp_path)).collect()


def test_nested_dialogs_across_ranges(small_ranges, tmp_path):
    turns = [[{"role": "user", "content": f"it's }} {i} \\ \" [" * (1 + i % 7)}, {"role": "assistant", "content": "ok"}] for i in range(40)]
    (tmp_path / "d.json").write_text(json.dumps([{"conversation": t} for t in turns]))
    got = D.read_dialogs(small_ranges, str(tmp_path)).collect()
    assert {r.dialog_id: [m.asDict() for m in r.conversation] for r in got} == {f"d.json#{i}": t for i, t in enumerate(turns)}
    (tmp_path / "k").mkdir()
    (tmp_path / "k/keyed.json").write_text(json.dumps({f"retail_{i}": {"conversation": t} for i, t in enumerate(turns)} | {"air_1": {}}))
    keyed = D.read_keyed_dialogs(small_ranges, str(tmp_path / "k"), "retail").collect()
    assert {r.instance_id: [m.asDict() for m in r.conversation] for r in keyed} == {f"retail_{i}": t for i, t in enumerate(turns)}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/tasks.json").write_text(json.dumps([{"description": "d}" * 100, "extra": i} for i in range(30)]))
    tasks = D.read_tasks(small_ranges, str(tmp_path / "t")).collect()
    assert {(r.task_id, r.metadata["extra"]) for r in tasks} == {(str(i), str(i)) for i in range(30)}


def test_events_of_strings():
    assert list(events('a" , "b', True)) == [(3, ","), (7, '"')]
    assert list(events('\\"', True)) == [(2, '"')] and list(events('"\\\\"]', False)) == [(4, "]")]
