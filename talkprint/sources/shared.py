"""Intermediate tables in the cluster's shared folder.

A derived table that several branches of a plan read is written once and read
back.  That cuts its lineage, survives lost executors, and unlike a cached or
locally checkpointed frame needs no executor storage.

Everything a process writes lies in one folder of its own, which
:func:`remove_scratch` deletes; :class:`Scratch` does so at the end of a block.
"""

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []  # paths handed out while somebody records them
_recording = False
_RUN = f"talkprint-{uuid.uuid4().hex[:12]}"


@functools.cache
def _single_machine_dir() -> str:
    path = tempfile.mkdtemp(prefix="talkprint-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a session that runs in one process gets a temporary
    folder, removed when the process ends; any other session fails, as executors
    would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _single_machine_dir()
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in this run's part of the shared folder."""
    path = f"{shared_dir(spark)}/{_RUN}/{name}-{uuid.uuid4().hex}"
    if _recording:
        _written.append(path)
    return path


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch paths that are handed out inside the block, in a list that is complete at its end."""
    global _recording
    _recording, found = True, []
    _written.clear()
    try:
        yield found
    finally:
        _recording = False
        found += _written


def remove_unread(paths: list[str], frame: DataFrame) -> list[str]:
    """Delete the scratch tables among ``paths`` that ``frame`` does not read; returns the others."""
    folders = {f.rpartition("/")[0] for f in frame.inputFiles()}
    read = {p for p in paths if any(f.endswith(p.partition(_RUN)[2]) for f in folders)}
    for path in set(paths) - read:
        where, place = fs.FileSystem.from_uri(path)
        if where.get_file_info(place).type != fs.FileType.NotFound:
            where.delete_dir(place)
    return [p for p in paths if p in read]


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this process wrote; frames that read it can no longer be used."""
    where, path = fs.FileSystem.from_uri(f"{shared_dir(spark)}/{_RUN}")
    if where.get_file_info(path).type != fs.FileType.NotFound:
        where.delete_dir(path)


class Scratch:
    """``with Scratch(spark): ...`` removes this process's intermediate tables at the end of the block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *failure) -> None:
        remove_scratch(self.spark)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
