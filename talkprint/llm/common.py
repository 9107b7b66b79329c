"""Small helpers shared by the operators of this subpackage."""

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SLICE_ROWS = 1000


_MISSING = object()


class Recent(dict):
    """A bounded table of results by key, for a Python worker.

    ``make`` gives the result of a key that is not there.  When ``limit`` results are
    held they become the older half, from which those still in use come back; so
    the most recent ``limit`` keys are always at hand, and twice as many at most.
    Keys that ``keep`` refuses are made every time.
    """

    def __init__(self, make: Callable, limit: int, keep: Callable = lambda key: True):
        self.make, self.limit, self.keep, self.older = make, max(1, limit), keep, {}

    def __missing__(self, key):
        value = self.older.pop(key, _MISSING)
        if value is _MISSING:
            value = self.make(key)
            if not self.keep(key):
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; every operator takes such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8(col) -> "F.Column":
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def give_back() -> None:
    """Return what this process has freed to the machine.

    Spark reuses Python workers from stage to stage; what the allocators of one
    stage hold on to would be missing beside the next one's tables.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[list]], schema: str) -> DataFrame:
    """``mapInArrow`` over plain Python columns.

    ``fn`` gets an iterator of ``{column: list}`` batches and yields lists of columns
    in the order of ``schema``.  Spark bounds its Arrow batches by rows and bytes;
    slices of them become Python objects, so that few texts are held twice.
    A task that ends gives free memory back (:func:`give_back`).
    """
    out_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        slices = (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))
        plain = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in slices)
        try:
            for columns in fn(plain):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )
        finally:
            columns = None
            give_back()

    return df.mapInArrow(run, schema)
