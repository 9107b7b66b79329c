"""Large JSON files that are one array or one object, read by as many tasks as Spark cuts ranges.

Spark's text scan splits a file at byte offsets, whatever store it lies in, once
closing braces are its line ends.  What a range alone cannot know is whether it
begins inside a string and how deep.  So every range is scanned for both cases
first and leaves a summary: how the depth changes, and whether it ends inside a
string.  The summaries of a file, a few rows, are folded in order and give each
range the state it begins in.  A second scan then cuts the ranges at the commas of
the outermost level.  Members that lie across ranges are put together from their
pieces; all others never move.
"""

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkprint.sources.shared import settle

BREAK = "}"
OPENERS = {"array": "[", "object": "{"}
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"?|[\[\]{},]', re.DOTALL)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*+"?', re.DOTALL)


def _closed(token: str) -> bool:
    """Whether a string that begins with its quote has come to its end."""
    if len(token) < 2 or token[-1] != '"':
        return False
    return token[-2] != "\\" or _STRING.fullmatch(token) is not None


def events(text: str, in_string: bool) -> Iterator[tuple[int, str]]:
    """(place, sign) of the brackets and commas outside of strings, then ``(len(text), '"')`` if a string is open at the end.

    ``text`` may begin in a string, but not after a backslash.
    """
    at = 0
    if in_string:
        at = _REST_OF_STRING.match(text).end()
        if not at or not _closed('"' + text[:at]):
            yield len(text), '"'
            return
    for m in _TOKEN.finditer(text, at):
        sign = m[0]
        if sign[0] != '"':
            yield m.start(), sign
        elif not _closed(sign):
            yield len(text), '"'
            return


def _summary(text: str, in_string: bool) -> tuple[int, bool]:
    depth, open_string = 0, False
    for _, sign in events(text, in_string):
        if sign in "[{":
            depth += 1
        elif sign in "]}":
            depth -= 1
        elif sign == '"':
            open_string = True
    return depth, open_string


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[str]]]:
    """Runs of rows of one range: their first row without the text, and the texts."""
    for batch in batches:
        rows = batch.to_pylist()
        start = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or (rows[k]["path"], rows[k]["block"]) != (rows[start]["path"], rows[start]["block"]):
                yield rows[start], [r["value"] for r in rows[start:k]]
                start = k


def _scan(spark: SparkSession, path) -> DataFrame:
    """``file, path, block, size, n, value``: texts between closing braces; ``n`` ascends inside a range."""
    meta = {"file": "file_name", "path": "file_path", "block": "file_block_start", "size": "file_size"}
    named = [F.col(f"_metadata.{field}").alias(name) for name, field in meta.items()]
    return spark.read.option("lineSep", BREAK).text(path).select(*named, F.monotonically_increasing_id().alias("n"), "value")


_SUMMARY = pa.schema([
    ("path", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("used", pa.int64()), ("head", pa.string()),
    ("outside_depth", pa.int64()), ("outside_open", pa.bool_()), ("inside_depth", pa.int64()), ("inside_open", pa.bool_()),
])
_STATE = "path string, block long, depth long, in_string boolean, after boolean, first boolean, last boolean, ends_with_break boolean"
#: So many ranges at most have their states sent to all tasks.
FEW_STATES = 100_000


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for row, texts in _ranges(batches):
        key = row["path"], row["block"], row["size"]
        if held is None or held[0] != key:
            if held is not None:
                yield _summary_row(*held)
            held = [key, 0, "", [(0, False), (0, True)]]
        text = BREAK.join(texts) + BREAK
        held[1] += len(text.encode())
        held[2] = held[2] or text.lstrip()[:1]
        held[3] = [(depth + change, now) for depth, was in held[3] for change, now in [_summary(text, was)]]
    if held is not None:
        yield _summary_row(*held)


def _summary_row(key: tuple, used: int, head: str, ends: list) -> pa.RecordBatch:
    values = [*key, used, head, *ends[0], *ends[1]]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SUMMARY)], schema=_SUMMARY)


def _states(layout: str, what: str):
    """The state in which each range of a file begins."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        depth, in_string, seen, out = 0, False, False, []
        for r in pdf.itertuples():
            out.append((r.path, r.block, depth, in_string, seen and not depth, not out, False, True))
            seen = seen or bool(r.head)
            depth += r.inside_depth if in_string else r.outside_depth
            in_string = bool(r.inside_open if in_string else r.outside_open)
        head = next((h for h in pdf["head"] if h), "")
        # The scan ends every text with a break, though the file may not.
        breaks = int(pdf["used"].sum()) == int(pdf["size"].iloc[0])
        out[-1] = (*out[-1][:6], True, breaks)
        if head != OPENERS[layout]:
            raise ValueError(f"{what} file must be a JSON {layout}: {pdf['path'].iloc[0]}")
        if in_string or depth + (not breaks) != 0:
            raise ValueError(f"{what} file ends inside of a value: {pdf['path'].iloc[0]}")
        return pd.DataFrame(out, columns=[c.split()[0] for c in _STATE.split(", ")])

    return fold


_PIECE = pa.schema([
    ("file", pa.string()), ("path", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("edge", pa.bool_()), ("text", pa.string()),
])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of members; number 0 of a range goes on with the last of the range before."""
    key, held, waiting = None, [], None
    depth = k = 0
    in_string = after = False

    def piece(done: list[str], end: bool = False) -> pa.RecordBatch:
        """Members up to number ``k``; the first of a range and its last may go on in other ranges of the file."""
        first = key[0]
        if end and k == 0 and first["first"] and first["last"] and not done[0].strip():
            done = []  # an empty array or object
        n = len(done)
        numbers = range(k - n + 1, k + 1)
        edges = [not number and not first["first"] or end and number == k and not first["last"] for number in numbers]
        columns = [[first["file"]] * n, [first["path"]] * n, [first["block"]] * n, list(numbers), edges, done]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)

    def walk(text: str) -> list[str]:
        nonlocal depth, in_string, after, held
        done, start, began_in = [], 0, in_string
        in_string = False
        for at, sign in events(text, began_in):
            if sign == '"':
                in_string = True
            elif sign == ",":
                if depth == 1:
                    held.append(text[start:at])
                    done.append("".join(held))
                    held, start = [], at + 1
            elif sign in "[{":
                depth += 1
                if depth == 1:
                    if after or text[start:at].strip():
                        raise ValueError("more than one outermost value")
                    start = at + 1
            else:
                depth -= 1
                if depth == 0:
                    held.append(text[start:at])
                    start, after = at + 1, True
        if depth:
            held.append(text[start:])
        elif text[start:].strip():
            raise ValueError("text outside of the outermost value")
        return done

    def flush(last: bool) -> list[str]:
        # The last break of a file that does not end with one was added by the scan.
        text = waiting if not (last and key[0]["last"] and not key[0]["ends_with_break"]) else waiting[:-1]
        return walk(text)

    for row, texts in _ranges(batches):
        if key is None or key[1] != (row["path"], row["block"]):
            if key is not None:
                done = flush(True) + ["".join(held)]
                k += len(done) - 1
                yield piece(done, True)
            key = row, (row["path"], row["block"])
            depth, in_string, after, held, k = row["depth"], row["in_string"], row["after"], [], 0
        elif (done := flush(False)):
            k += len(done) - 1
            yield piece(done)
            k += 1
        waiting = BREAK.join(texts) + BREAK
    if key is not None:
        done = flush(True) + ["".join(held)]
        k += len(done) - 1
        yield piece(done, True)


def read_members(spark: SparkSession, path, layout: str, what: str = "JSON") -> DataFrame:
    """``(file, path, i, text)``: the members of files that hold one array or one object each, in their order.

    A member of an object is its key, a colon and its value.  Files that hold
    anything else, or end early, fail; a file of no bytes has no members.
    """
    scan = _scan(spark, path)
    summaries = scan.select("path", "block", "size", "value").mapInArrow(
        _summaries, "path string, block long, size long, used long, head string, outside_depth long, outside_open boolean, "
        "inside_depth long, inside_open boolean",
    )
    states = settle(summaries.groupBy("path").applyInPandas(_states(layout, what), _STATE), "range-states")
    if states.count() <= FEW_STATES:
        begun = scan.join(F.broadcast(states), ["path", "block"])
    else:
        begun = scan.join(states, ["path", "block"]).repartition("path", "block")
    cut = begun.sortWithinPartitions("path", "block", "n").mapInArrow(
        _members, "file string, path string, block long, k long, edge boolean, text string"
    )
    pieces = settle(cut, "members")
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("path", "block").agg(F.max("k").alias("last"))
    starts = counts.select("path", "block", F.coalesce(F.sum("last").over(ahead), F.lit(0)).alias("start"))
    ends = counts.groupBy("path").agg(F.sum("last").alias("final"))
    placed = pieces.join(starts, ["path", "block"]).withColumn("i", F.col("start") + F.col("k"))
    # Guarded, as conditions on whole members may be tried on pieces first.
    whole = F.when(~F.col("edge"), F.col("text")).alias("text")
    inner = placed.where(~F.col("edge")).select("file", "path", "i", whole)
    edge = placed.where("edge").groupBy("file", "path", "i").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text")
    )
    # An empty array or object is one blank member; a blank anywhere else is an error that parsing finds.
    empty = edge.where((F.col("i") == 0) & F.col("text").rlike(r"\A\s*\z")).join(ends.where("final = 0"), "path", "left_semi")
    return inner.unionByName(edge.join(empty.select("path"), "path", "left_anti"))


def read_array(spark: SparkSession, path, what: str = "JSON") -> DataFrame:
    """``(file, i, v)``: the records of files that are one JSON array each, as variants with their place."""
    return read_members(spark, path, "array", what).select("file", "i", F.parse_json("text").alias("v"))


def read_object(spark: SparkSession, path, what: str = "JSON") -> DataFrame:
    """``(file, i, key, v)``: the members of files that are one JSON object each; of equal keys in a file the last counts."""
    parsed = read_members(spark, path, "object", what).select(
        "file", "path", "i", F.parse_json(F.concat(F.lit("{"), "text", F.lit("}"))).alias("_whole")
    )
    items = settle(
        parsed.lateralJoin(spark.tvf.variant_explode(F.col("_whole").outer())).select("file", "path", "i", "key", F.col("value").alias("v")), "entries"
    )
    again = items.groupBy("path", "key").agg(F.count("*").alias("_n"), F.max("i").alias("_last")).where("_n > 1")
    kept = items.join(again.drop("_n"), ["path", "key"], "left").where("_last is null or _last = i")
    return kept.select("file", "i", "key", "v")
