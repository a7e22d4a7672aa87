"""A stream of diffs, each batch of which runs the batch plan. Goes beyond the batch commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Options, changes_of, validate


def validate_stream(spark: SparkSession, diffs: str, files: DataFrame, out: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Watches the folder ``diffs`` and appends the violations of every new diff to the Parquet folder ``out``.

    ``files`` is the tree after the diffs. A batch that is run again after a failure replaces
    what it wrote, since every batch has a folder of its own.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            validate(files, changes_of(rows.withColumnRenamed("value", "text")), options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.text(diffs, wholetext=True)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
