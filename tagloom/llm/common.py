"""Helpers that the corpus operators share: row keys, lineage cuts, table access."""

from __future__ import annotations

import os
import pickle
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder below ``spark.checkpoint.dir``. A local session that names none
    gets one under the warehouse folder; a cluster's must name one that all its machines share.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get(CHECKPOINT_KEY)
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"{CHECKPOINT_KEY} isn't set: it must name a folder that all executors share")
        sc.setCheckpointDir(where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder of the cluster and returns it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to a fresh folder in the shared one and reads it back."""
    where = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a row: rows that repeat both id and text share it, nulls count as values."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\0null")), F.lit("|"), F.col(text).isNull(), F.col(text))


def parts_for(rows: int, row_bytes: int, target: int = 24_000_000, least: int = 1) -> int:
    """Partitions so that each holds about ``target`` bytes."""
    return max(least, -(-rows * row_bytes // target))


#: Ids, a few bytes each, that a join may send to every executor; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def sized(ids: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids, with the hint to broadcast it if it is counted to be small.

    Without it the plan would shuffle all texts before it learns how few ids there are.
    """
    return F.broadcast(ids) if ids.count() <= limit else ids


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts an object with the classes of this package that it is made of; the function returned gives it to a task."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)
