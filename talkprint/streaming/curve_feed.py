"""Incremental form of the append-only curve.

The batch reader re-reads the whole curve on each refresh.  Here a file source
picks up only new files and appends them to the curve table; the checkpoint
makes every file count once across restarts.
"""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkprint.sources.tables import TRAIN_CURVE


def follow_curve(
    spark: SparkSession, source: str, table: str, checkpoint: str, schema: str = TRAIN_CURVE, once: bool = True
) -> StreamingQuery:
    """Start the feed; ``once`` drains what is there and stops."""
    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(source)
    fresh = rows.withColumn("iteration", F.coalesce("iteration", F.lit(0)))
    writer = fresh.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start(table)
