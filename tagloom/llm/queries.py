"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .classifier import accepted
from .common import table
from .credentials import linked
from .decontaminate import contained_items
from .divergence import kept
from .licenses import find_licenses
from .oracles import decontamination, divergence, packing_holds, sharding_holds
from .oracles import suffixes as suffixes_sql
from .packing import CAPACITY, pack
from .pii import find_pii
from .sharding import shuffled
from .simhash import near_duplicates
from .suffixes import repeats


def _packed(s: SparkSession, d: str) -> DataFrame:
    """What must hold of packed bins, whatever the packing: every word is placed once, no bin is overfull, and no two pieces overlap in one."""
    rows = pack(table(s, d, "documents"))
    w = Window.partitionBy("bin_id").orderBy("offset")
    wrong = (F.col("offset") + F.col("n_words") > CAPACITY) | (F.lag(F.col("offset") + F.col("n_words")).over(w) > F.col("offset"))
    return rows.withColumn("wrong", F.coalesce(wrong, F.lit(False)).cast("bigint")).groupBy("doc_id").agg(F.sum("n_words").alias("words"), F.count("*").alias("pieces"), F.sum("wrong").alias("wrong"))


def _sharded(s: SparkSession, d: str) -> DataFrame:
    """What must hold of shards: every row is there once, and positions count from 0 without a gap."""
    rows = shuffled(table(s, d, "documents"), buckets=7)
    shard = rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("position").alias("positions"), F.max("position").alias("last"))
    gaps = shard.agg(F.sum(F.when((F.col("n") == F.col("positions")) & (F.col("n") == F.col("last") + 1), 0).otherwise(1)).alias("gaps"))
    return rows.groupBy("doc_id", "lang", "source", "n_chars").agg(F.count("*").alias("n")).crossJoin(F.broadcast(gaps))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_decontamination": lambda s, d: contained_items(docs(s, d), table(s, d, "benchmark")),
        "op2_suffixes": lambda s, d: repeats(docs(s, d)),
        "op3_divergence": lambda s, d: kept(docs(s, d)),
        "op4_pii": lambda s, d: find_pii(docs(s, d)),
        "op5_simhash": lambda s, d: near_duplicates(docs(s, d)),
        "op6_sharding": lambda s, d: shuffled(docs(s, d)),
        "op7_credentials": lambda s, d: linked(docs(s, d)),
        "op8_licenses": lambda s, d: find_licenses(docs(s, d)),
        "op9_classifier": lambda s, d: accepted(docs(s, d), table(s, d, "labels")),
        "op10_packing": lambda s, d: pack(docs(s, d)),
        "packing_holds": _packed,
        "sharding_holds": _sharded,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination(), "op2_suffixes": suffixes_sql(), "op3_divergence": divergence(), "packing_holds": packing_holds(), "sharding_holds": sharding_holds()}
