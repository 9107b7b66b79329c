import json
import os

import pytest
from pyspark.sql import functions as F

from talkprint.functions.banks import FEATURES
from talkprint.operators import clean, prompts
from talkprint.sources import dialogs as D
from talkprint.sources import tables as T
from talkprint.sources.shared import Scratch, scratch, shared_dir

CONV = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "hello"}]


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_dialogs_array(spark, tmp_path):
    path = put(tmp_path, "d.json", json.dumps([{"conversation": CONV, "metadata": {"a": 1}}, {"turns": CONV[:1]}], indent=1))
    rows = {r.dialog_id: r for r in D.read_dialogs(spark, path).collect()}
    assert set(rows) == {"d.json#0", "d.json#1"} and rows["d.json#0"].metadata == {"a": "1"}
    turns = D.to_turns(D.read_dialogs(spark, path)).where("dialog_id = 'd.json#0'").orderBy("turn").collect()
    assert [(r.turn, r.role, r.content) for r in turns] == [(0, "user", "hi"), (1, "assistant", "hello")]


@pytest.mark.parametrize("text,message", [('{"conversation": []}', "must be a JSON array"), ('[{"x": 1}]', "conversation")])
def test_read_dialogs_errors(spark, tmp_path, text, message):
    with pytest.raises(Exception, match=message):
        D.read_dialogs(spark, put(tmp_path, "d.json", text)).collect()


def test_empty_conversation_rule(spark, tmp_path):
    path = put(tmp_path, "d.json", json.dumps([{"conversation": [], "turns": CONV}, {"conversation": None}, {"turns": CONV}]))
    plain = [r.conversation and len(r.conversation) for r in D.read_dialogs(spark, path).collect()]
    assert [n or 0 for n in plain] == [0, 0, 2]
    assert [len(r.conversation or []) for r in D.read_dialogs(spark, path, empty_falls_back=True).collect()] == [2, 0, 2]


def test_read_tasks(spark, tmp_path):
    data = [{"task_id": "t1", "description": "return laptop", "context": "retail", "extra": {"k": [1]}, "n": 2}, {"description": 5}]
    rows = D.read_tasks(spark, put(tmp_path, "t.json", json.dumps(data))).collect()
    assert [(r.task_id, r.description, r.context) for r in rows] == [("t1", "return laptop", "retail"), ("1", "5", "")]
    assert rows[0].metadata == {"extra": '{"k":[1]}', "n": "2"} and rows[1].metadata == {}
    with pytest.raises(Exception, match="description"):
        D.read_tasks(spark, put(tmp_path, "bad.json", '[{"task_id": 1}]')).collect()


def test_task_round_trip(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "do", "", {"x": "1"})], "task_id string, description string, context string, metadata map<string,string>")
    D.write_tasks(tasks, str(tmp_path / "out"))
    assert D.read_tasks(spark, str(tmp_path / "out"), "lines").collect() == tasks.collect()


def test_text_dialogs(spark, tmp_path):
    text = (
        "ignored\nUSER: Hi,\r\n  more\n\nassistant:  Of course \x0b and on\nUser:\n---\n\n---\nnobody speaks\n---"
        "ASSISTANT:\n x---USER: last one"
    )
    got = [[(m.role, m.content) for m in r.conversation] for r in D.read_text_dialogs(spark, put(tmp_path, "d.txt", text)).collect()]
    assert sorted(got) == sorted([
        [("user", "Hi, more"), ("assistant", "Of course and on")], [("assistant", "x")], [("user", "last one")],
    ])


def test_keyed_dialogs(spark, tmp_path):
    data = {"retail_1_ann2": {"conversation": CONV}, "retailer_1": {"conversation": CONV}, "retail_2": {"conversation": []}, "retail_3": {}}
    rows = D.read_keyed_dialogs(spark, put(tmp_path, "k.json", json.dumps(data)), "retail").collect()
    assert [(r.instance_id, len(r.conversation)) for r in rows] == [("retail_1_ann2", 2)]


def test_record_files_skip_blank_lines(spark, tmp_path):
    paths = [put(tmp_path, "a.jsonl", '{"u": 1, "p": {"x": 1}}\n\n'), put(tmp_path, "b.jsonl", '{"u": 2, "p": null}\n')]
    rows = D.read_record_files(spark, paths, "u int, p string").collect()
    assert sorted((r.u, r.p) for r in rows) == [(1, '{"x": 1}'), (2, None)] or sorted((r.u, r.p) for r in rows) == [(1, '{"x":1}'), (2, None)]


def test_curve(spark, tmp_path):
    put(tmp_path, "c.jsonl", '{"iteration": 3, "train_combined": 0.5}\n\nnot json\n{"train_combined": 0.1}\n{"iteration": 1}\n')
    assert [r.iteration for r in T.load_curve(spark, str(tmp_path)).collect()] == [None, 1, 3]


def test_episode_store(spark, tmp_path):
    path = str(tmp_path / "eps")
    df = spark.createDataFrame([("a", "default", 1.0), ("b", "default", None), ("c", "dp", 2.0)], "task_id string, condition string, words_per_turn double")
    T.save_episodes(df, path)
    assert [r.task_id for r in T.load_episodes(spark, path, "default").collect()] == ["a"]
    with pytest.raises(ValueError):
        T.load_episodes(spark, path, "initial")


def test_human_fallbacks(spark, turns):
    df = turns({"a": [("user", "please"), ("assistant", "x")], "b": [("user", "no")]})
    ref, individual = T.build_reference(df, "s", "d")
    assert T.human_fingerprints(individual, df, ref).count() == 1
    assert T.human_fingerprints(None, df, ref).count() == 2
    with pytest.warns(UserWarning):
        mean = T.human_fingerprints(None, None, ref).collect()
    assert len(mean) == 1 and mean[0].politeness_rate == 0.5 and set(FEATURES) < set(mean[0].asDict())
    with pytest.raises(ValueError):
        T.human_fingerprints()


def test_curve_feed_counts_every_file_once(spark, tmp_path):
    from talkprint.streaming.curve_feed import follow_curve

    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for part in ([1, 2], [3]):
        T.append_curve(spark.createDataFrame([(i,) for i in part], "iteration int"), src)
        follow_curve(spark, src, out, state).awaitTermination()
    assert sorted(r.iteration for r in spark.read.parquet(out).collect()) == [1, 2, 3]


class Session:
    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(Session(spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert scratch(spark, "a") != scratch(spark, "a")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_executors_elsewhere_need_a_shared_dir(master):
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(Session(spark_master=master))


def test_scratch_is_removed_at_the_end(spark, tmp_path):
    own = Session(spark_checkpoint_dir=str(tmp_path))
    with Scratch(own):
        path = scratch(own, "gone")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path)
    assert not os.path.exists(path)


# ----------------------------------------------------------------- cleaning


def contents(df):
    return [(r.role, r.content) for r in df.orderBy("dialog_id", "turn").collect()]


def test_stop_marker_is_cut_and_removed(turns):
    d = turns({"d": [("user", "hi i need help"), ("assistant", "saw"), ("user", "thanks bye [DONE]"), ("assistant", "late"), ("user", "[DONE]")]})
    assert contents(clean.truncate_keeping_stop(d)) == [("user", "hi i need help"), ("assistant", "saw"), ("user", "thanks bye")]
    assert [c for _, c in contents(clean.truncate_before_stop(d, "[DONE]"))] == ["hi i need help", "saw"]


def test_turn_cap(turns):
    d = turns({"d": [(r, f"{r}{i}") for i in range(20) for r in ("user", "assistant")]})
    assert [r for r, _ in contents(clean.cap_turns(d, 4))] == ["user", "assistant"] * 4
    assert clean.cap_turns(d, 3, by_role=False).count() == 3


def test_leading_setup(turns):
    d = turns({
        "a": [("user", "\\tau x"), ("user", "see <|canvas|>"), ("user", "real"), ("user", "\\tau kept")],
        "b": [("user", "\\tau x"), ("user", "only one")], "c": [("user", " \\tau x")],
    })
    assert contents(clean.strip_leading_setup(d)) == [("user", "real"), ("user", "\\tau kept")]


def test_prose_rules(spark):
    cases = {
        "": False, " \n": False, "fine": True, "a ``` b": False, "a <b": False, "a < b": True, "</x": False,
        "\n".join("x" * 15): True, "\n".join("x" * 16): False, "y" * 400: True, "ok\n" + "y" * 401: False, "é" * 400 + "\nz": True,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.p for r in df.select("t", clean.is_prose(F.col("t")).alias("p")).collect()} == cases


def test_failure_modes_across_turns(turns):
    """Phrases may straddle turns, also in dialogues too long to assemble."""
    filler = [("user", "x")] * 30
    d = {
        "inside": [("assistant", "Sorry, I cannot help")],
        "straddle": [("assistant", "well I cannot"), ("user", "?"), ("assistant", "help")],
        "three": [("assistant", "i"), ("assistant", "can't"), ("assistant", "assist")],
        "long": filler + [("assistant", "we cannot help")],
        "long straddle": [("assistant", "so i'm unable")] + filler + [("assistant", "to do it")],
        "long three": [("assistant", "well, i")] + filler + [("assistant", "can't"), ("assistant", "assist you")],
        "long apart": [("assistant", "i")] + filler + [("assistant", "can't do much, but you"), ("assistant", "assist")],
        "clarify": [("assistant", "can you clarify can you clarify"), ("assistant", "can you clarify")],
        "assume": [("assistant", "Assuming you"), ("assistant", "want it")],
        "gave up": [("user", "oh never"), ("assistant", "mind")],
        "other": [("user", "forget item")],
    }
    df = turns(d)
    outcomes = df.select("dialog_id").distinct().withColumn("success", F.lit(False))
    got = {r.dialog_id: r.failure_mode for r in clean.failure_modes(df, outcomes).collect()}
    gave_up = {k for k, v in got.items() if v == "agent_gave_up"}
    assert gave_up == {"inside", "straddle", "three", "long straddle", "long three"}
    assert {k: got[k] for k in ("long", "long apart", "clarify", "assume", "gave up", "other")} == {
        "long": "max_turns_exceeded", "long apart": "max_turns_exceeded", "clarify": "clarification_loop",
        "assume": "agent_assumed", "gave up": "user_abandoned", "other": "other",
    }
    won = clean.failure_modes(df, outcomes.withColumn("success", F.lit(True)))
    assert won.where("failure_mode is not null").count() == 0


# ------------------------------------------------------------------ prompts


def test_render_persona(spark):
    base, persona = "You are a customer. Goal: return a laptop.", "Be terse. Reveal one symptom."
    row = spark.range(1).select(
        prompts.render_persona(F.lit(base), F.lit(persona)).alias("full"), prompts.render_persona(F.lit(base), F.lit(" ")).alias("skip"),
        prompts.render_persona(F.lit(base), F.lit(""), skip_blank=False).alias("kept"),
    ).first()
    assert base in row.full and persona in row.full and row.skip == base and row.kept.startswith(base + "\n\n")


def test_a_hopelessly_nested_reply_is_one_bad_row(spark):
    df = spark.createDataFrame([(1, "[" * 20_000), (2, '{"persona_id": "a", "expanded_instruction": "x"}')], "response_id int, raw string")
    rows = {r.response_id: r.persona_id for r in prompts.parse_personas(df, ["terse"], 1).collect()}
    assert rows == {1: None, 2: "a"}


def test_a_stray_turn_in_another_group_is_not_kept(spark):
    prose = "this is a plain sentence with enough words to count as prose"
    rows = [(d, i, "user", f"{prose} {i}", "repo") for d in ("a", "b", "c") for i in range(2)] + [("a", 9, "user", prose, "other")]
    df = spark.createDataFrame(rows, "dialog_id string, turn int, role string, content string, repo string")
    kept = clean.clean_dialogs(df, "repo").collect()
    assert len(kept) == 6 and {r.repo for r in kept} == {"repo"}


@pytest.mark.parametrize("split", ["64", "200", "128m"])
def test_places_do_not_depend_on_file_splits(spark, tmp_path, split):
    tasks = put(tmp_path, "t.jsonl", "\n".join(json.dumps({"description": f"d{i}"}) for i in range(40)))
    dialogs = put(tmp_path, "d.jsonl", "\n".join(json.dumps({"turns": [{"role": "user", "content": f"c{i}"}]}) for i in range(40)))
    texts = put(tmp_path, "x.txt", "---".join(f"USER: c{i}\n" for i in range(40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert {r.task_id: r.description for r in D.read_tasks(spark, tasks, "lines").collect()} == {str(i): f"d{i}" for i in range(40)}
        for df, name in ((D.read_dialogs(spark, dialogs, "lines"), "d.jsonl"), (D.read_text_dialogs(spark, texts), "x.txt")):
            assert {r.dialog_id: r.conversation[0].content for r in df.collect()} == {f"{name}#{i}": f"c{i}" for i in range(40)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_checks_stay_when_other_columns_are_read(spark, tmp_path):
    bad = put(tmp_path, "b.jsonl", json.dumps({"x": 1}))
    with pytest.raises(Exception, match="conversation"):
        D.read_dialogs(spark, bad, "lines").select("dialog_id").collect()
    with pytest.raises(Exception, match="description"):
        D.read_tasks(spark, bad, "lines").select("task_id").collect()
    with pytest.raises(Exception, match="JSON array"):
        D.read_tasks(spark, put(tmp_path, "o.json", '{"a": 1}')).select("task_id").collect()


def test_parse_personas(spark):
    good = '{"persona_id": "a", "expanded_instruction": "x", "axis_placement": {"terse": "Yes", "odd": true}}'
    raws = {
        1: f"```json\n[{good}, 5, {good}]\n```", 2: f"[1] then {good}{good}", 3: "nothing", 4: f"[{good}, {{bad", 5: '[["in", {"persona_id": "z"}]]', 6: None,
    }
    df = spark.createDataFrame(list(raws.items()), "response_id int, raw string")
    rows = prompts.parse_personas(df, ["terse", "calm"], 2).orderBy("response_id", "pos").collect()
    assert [(r.response_id, r.pos, r.persona_id, r.complete) for r in rows] == [
        (1, 0, "a", True), (1, 1, "a", True), (2, 0, "a", True), (2, 1, "a", True), (3, None, None, False), (4, 0, "a", False),
        (5, 0, "z", False), (6, None, None, False),
    ]
    assert rows[0].axis_placement == {"terse": True, "calm": False}


def test_fixed_decimals_are_exact(spark):
    from talkprint.functions.text import fixed

    values = [k / n for n in (3, 7, 16, 40, 80, 320, 2000) for k in range(0, 2 * n, 3)] + [0.0, -0.0125, -0.0001, 123456.0625, 0.2995, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", *[fixed(F.col("x"), d).alias(f"d{d}") for d in (1, 3, 4)]).collect()
    for r in rows:
        assert (r.d1, r.d3, r.d4) == (f"{r.x:.1f}", f"{r.x:.3f}", f"{r.x:.4f}"), r.x


def test_scenario_and_indent(spark):
    df = spark.createDataFrame([("p\n\nq", {"b": "2", "a": "1\n \n3"}), (" ", {"k": None})], "p string, m map<string,string>")
    got = [r[0] for r in df.select(prompts.scenario(F.col("p"), F.col("m"))).collect()]
    assert got == ["Base Persona:\n\tp\n\n\tq\nGiven Instructions:\n\ta: 1\n \n\t3\n\tb: 2", "Given Instructions:\n\tk: None"]


def test_traits_and_axes(spark):
    axes = spark.createDataFrame(
        [("terse", "short", "few words", "many", 0), ("calm", "", "slow", "", 1), ("mute", "", "", "", 2), (" ", "", "", "", 3)],
        "behavior string, definition string, on_text string, off_text string, pos int",
    )
    people = spark.createDataFrame(
        [(1, {"calm": "on", " terse ": "TRUE", "mute": "1", "new": "yes"}), (2, {"terse": "no"}), (3, {})], "persona_key int, axis_placement map<string,string>"
    )
    got = {r.persona_key: r.active_traits for r in prompts.active_traits(people, axes).collect()}
    assert got[1] == "- calm (on): slow\n- terse (on)\n  Definition: short\n  Playbook: few words"
    assert got[2] == got[3] == prompts.NEUTRAL_TRAITS
    text = prompts.axes_description(axes).first()[0]
    assert text.startswith("terse\n  - definition: short\n  - presence true (on): few words\n  - presence false (off): many\ncalm\n  - presence true (on): slow")
    assert text.endswith("?\n  - presence true (on): \n  - presence false (off): ")


def test_iteration_log_has_files_by_range_not_by_iteration(spark, tmp_path):
    its = spark.range(300).select(F.col("id").alias("iteration"))
    metrics = its.select("iteration", (F.col("iteration") * 0.5).alias("combined_score"))
    personas = its.select("iteration", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"), F.lit("t").alias("task_id"))
    path = str(tmp_path / "log")
    T.append_iteration_log(metrics, personas, path)
    back = spark.read.parquet(path)
    files = back.select("iteration", F.input_file_name().alias("f")).groupBy("iteration").agg(F.count_distinct("f").alias("n"), F.max("f").alias("f")).collect()
    assert len(files) == 300 and {r.n for r in files} == {1} and len({r.f for r in files}) <= 4
    T.append_iteration_log(metrics.where("iteration < 2"), personas, path, "val")
    back = spark.read.parquet(path)
    assert back.where("phase = 'train'").count() == 1200 and back.where("phase = 'val'").count() == 8
    assert {(r.iteration, r.combined_score) for r in back.where("iteration = 7").collect()} == {(7, 3.5)}
