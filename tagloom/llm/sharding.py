"""Two-pass external shuffle into shards.

The first pass scatters rows into buckets by a seeded hash of all of a row's columns and
of its number among the rows equal to it, so many buckets that one holds about
``BUCKET_BYTES``, counted over all columns, and fits in memory; the second brings each
bucket into a fixed order and gives it a Fisher-Yates shuffle with a generator seeded by
seed and bucket. The order depends on the rows and the seed alone, not on how the input
was divided or on which tasks were run again. A bucket is one partition, so it is written
as one file. Where a number of buckets is asked for that makes them larger than memory
allows, the same order comes from sorts on disk.

Defined cases: nulls are values; rows that repeat each other are scattered like others and
keep their number; texts may be null, empty or as long as a bucket; an empty table gives
an empty result; all columns are kept, and if one is called ``shard`` or ``position``
the new one gets an underscore more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, sized
from .spans import free_name

BUCKET_BYTES, SEED = 24_000_000, 20240229
#: Equal rows that are made anew by one task.
CHUNK = 10_000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0 .. n-1."""
    out = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist()):
        out[i], out[j] = out[j], out[i]
    return np.array(out, dtype=np.int64)


def _kind_has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _kind_has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_kind_has_map(f.dataType) for f in kind.fields)


def _parts_of_rows(docs: DataFrame) -> list[Column]:
    """What a row's identity is made of: every column, and whether it is null."""
    out: list[Column] = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        out += [c.isNull(), F.to_json(c) if _kind_has_map(f.dataType) else c]
    return out


def _row_bytes(docs: DataFrame) -> Column:
    """About how many bytes a row has, over all columns."""
    size = F.lit(16)
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 8
    return size.cast("bigint")


def numbered(docs: DataFrame, k1: str, k2: str, nth: str) -> DataFrame:
    """``docs`` with a 128-bit identity of each row and the number of the row among those equal to it.

    Equal rows are interchangeable: of each group one is kept with its count, and the group
    is made anew from it, ``CHUNK`` rows at a time, so a group of any size is spread over
    tasks and its numbers don't depend on where its rows were read.
    """
    parts = _parts_of_rows(docs)
    rows = docs.withColumn(k1, F.xxhash64(F.lit(1), *parts)).withColumn(k2, F.xxhash64(F.lit(2), *parts))
    many = cut(rows.groupBy(k1, k2).agg(F.count("*").alias("n__")).where("n__ > 1"))
    once = rows.withColumn(nth, F.lit(0).cast("bigint"))
    if many.isEmpty():
        return once
    keys = sized(many.select(k1, k2))
    group = rows.join(keys, [k1, k2], "left_semi").groupBy(k1, k2).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row__"), F.count("*").alias("n__"))
    chunks = group.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n__") - 1) / CHUNK))).alias("chunk__")).repartition(k1, k2, "chunk__")
    last = F.least(F.col("n__"), (F.col("chunk__") + 1) * CHUNK) - 1
    again = chunks.select(k1, k2, "row__", F.explode(F.sequence(F.col("chunk__") * CHUNK, last)).alias(nth)).select("row__.*", k1, k2, nth)
    return once.join(keys, [k1, k2], "left_anti").select(*(F.col(f"`{c}`") for c in again.columns)).unionByName(again)


def _streamed(rows: DataFrame, seed: int, shard: str, position: str, keys: list[str], out: T.StructType) -> DataFrame:
    """Positions of ``rows``, a bucket a partition, where buckets are too large for a task's memory: Spark sorts them, on disk if need be, and Python holds numbers of rows."""
    counts = {r[0]: r[1] for r in rows.groupBy(shard).agg(F.count("*")).collect()}

    def run(batches):
        bucket, places, rank = None, None, 0
        for batch in batches:
            of = batch.column(shard).to_numpy()
            found = np.empty(len(of), dtype=np.int64)
            for b in np.unique(of).tolist():
                at = np.flatnonzero(of == b)
                if b != bucket:
                    bucket, rank = b, 0
                    places = np.empty(counts[b], dtype=np.int64)
                    places[fisher_yates(counts[b], np.random.default_rng([seed, b]))] = np.arange(counts[b])
                found[at] = places[rank : rank + len(at)]
                rank += len(at)
            yield batch.drop_columns(keys).append_column(position, pa.array(found))

    return rows.sortWithinPartitions(shard, *keys).mapInArrow(run, out).sortWithinPartitions(shard, position)


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, buckets: int | None = None) -> DataFrame:
    """``docs`` in shuffled shards: their columns, ``shard`` and ``position`` in it, in this order."""
    size = docs.agg(F.coalesce(F.sum(_row_bytes(docs)), F.lit(0))).first()[0]
    if buckets is None:
        buckets = max(1, -(-size // bucket_bytes))
    shard, position = free_name("shard", docs.columns), free_name("position", docs.columns)
    taken = [*docs.columns, shard, position, "row__", "n__", "chunk__"]
    k1, k2, nth = (free_name(n, taken) for n in ("key1", "key2", "nth"))
    out = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(position, T.LongType())])
    rows = numbered(docs, k1, k2, nth)
    rows = rows.withColumn(shard, F.pmod(F.xxhash64(F.lit(seed), F.col(k1), F.col(k2), F.col(nth)), F.lit(buckets)).cast("int")).repartitionById(buckets, F.col(shard))

    if size > 2 * bucket_bytes * buckets:
        return _streamed(rows, seed, shard, position, [k1, k2, nth], out)

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        of = table.column(shard).to_numpy()
        rank = np.lexsort([table.column(c).to_numpy() for c in (nth, k2, k1)])
        table = table.drop_columns([k1, k2, nth])
        for b in np.unique(of).tolist():
            order = rank[of[rank] == b]
            order = order[fisher_yates(len(order), np.random.default_rng([seed, b]))]
            for at in range(0, len(order), 2000):
                part = table.take(pa.array(order[at : at + 2000])).append_column(position, pa.array(np.arange(at, min(at + 2000, len(order)))))
                yield from part.combine_chunks().to_batches()

    return rows.mapInArrow(run, out)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the shuffled shards as Parquet, one file each."""
    shuffled(docs, **options).write.mode("overwrite").parquet(path)


