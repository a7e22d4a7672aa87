"""Best-fit packing by bulk-synchronous rounds.

Documents, measured in whitespace-separated words, fill bins of ``capacity`` words. A
longer document is cut into full pieces, each a bin of its own, and a remainder. Then,
in rounds, all unplaced pieces and all gaps are range-sorted by size, pieces before gaps
of the same size, equal ones by a hash, so that no size is bound to one partition. A successor sweep gives each gap the largest piece before it that no
smaller gap took; of pieces that want one gap the highest in rank gets it and the others
move on to the next gap. Partitions sweep on their own: what is left there is a run of
gaps below a run of pieces, so their counts alone, two numbers a partition, decide on
the driver which ranks of pieces go to which ranks of gaps of later partitions, and a
join carries that out. Gaps are updated and the next round begins. A gap that could hold
several of the largest remaining pieces is offered in equal slots. Where a round leaves
many pieces without a gap, bins for their total are opened.

Defined cases: texts without words, null or empty, take no room and get no row; null
and repeated ids and repeated rows are separate documents; ties of size go by a hash of
the row; an empty table gives no bins; other columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_for, row_key

CAPACITY = 2048
#: Pieces that one partition sweeps.
SWEEP_ROWS = 100_000


def sweep(size: np.ndarray, is_gap: np.ndarray, ident: np.ndarray) -> tuple[list, list, list]:
    """Matches (piece, gap), left pieces and left gaps of one sorted run, as indexes in order of size."""
    order = np.lexsort((ident, is_gap, size))
    waiting: list[int] = []
    pairs, idle = [], []
    for i, gap in zip(order.tolist(), is_gap[order].tolist()):
        if not gap:
            waiting.append(i)
        elif waiting:
            pairs.append((waiting.pop(), i))
        else:
            idle.append(i)
    return pairs, waiting, idle


def across(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (left pieces, left gaps) of each partition: runs (piece partition, its first rank, gap partition, its first rank, n).

    The piece of rank first + n - 1 goes to the gap of the first rank, and so on downwards.
    """
    out, stack = [], []
    for part in sorted(counts):
        pieces, gaps = counts[part]
        at = 0
        while at < gaps and stack:
            own, n = stack.pop()
            k = min(n, gaps - at)
            out.append((own, n - k, part, at, k))
            at += k
            if n > k:
                stack.append((own, n - k))
        if pieces:
            stack.append((part, pieces))
    return out


def _sweep_partition(batches):
    got = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if got is None:
        return
    size, is_gap, ident = (got.column(i).to_numpy() for i in range(3))
    pairs, pieces, gaps = sweep(size, is_gap, ident)
    part = TaskContext.get().partitionId()
    p = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    kind = np.repeat([2, 0, 1], [len(p), len(pieces), len(gaps)])
    rank = np.concatenate([np.zeros(len(p), np.int64), np.arange(len(pieces)), np.arange(len(gaps))])
    left = np.concatenate([p[:, 0], pieces, gaps]).astype(np.int64)
    right = np.concatenate([p[:, 1], pieces, gaps]).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, np.full(len(kind), part), rank, ident[left], size[left], ident[right])], ["kind", "part", "rank", "item", "size", "bin"])


def _round(items: DataFrame, bins: DataFrame, largest: int, parts: int) -> DataFrame:
    """One round's placements: item, size, bin."""
    slots = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("gap") / largest))
    offered = bins.select(F.floor(F.col("gap") / slots).alias("size"), F.explode(F.sequence(F.lit(1).cast("bigint"), slots)).alias("slot"), "bin").select("size", F.lit(1).alias("is_gap"), F.col("bin").alias("ident"))
    both = items.select("size", F.lit(0).alias("is_gap"), F.col("item").alias("ident")).unionByName(offered)
    # sizes are few, so ranges are of the whole order: equal sizes go to as many partitions as they fill
    swept = both.repartitionByRange(parts, "size", "is_gap", "ident") if parts > 1 else both.coalesce(1)
    swept = cut(swept.mapInArrow(_sweep_partition, "kind bigint, part bigint, rank bigint, item bigint, size bigint, bin bigint"))
    placed = swept.where("kind = 2").select("item", "size", "bin")
    if parts > 1:
        counts: dict[int, list[int]] = {}
        for r in swept.where("kind < 2").groupBy("part", "kind").count().collect():
            counts.setdefault(r.part, [0, 0])[r.kind] = r["count"]
        if runs := across({k: tuple(v) for k, v in counts.items()}):
            # at most two runs a partition, so this never outgrows the plan
            table = F.broadcast(items.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(runs)], "run int, p long, p0 long, g long, g0 long, n long"))
            piece = swept.where("kind = 0").join(table, (F.col("part") == F.col("p")) & F.col("rank").between(F.col("p0"), F.col("p0") + F.col("n") - 1)).select("run", (F.col("p0") + F.col("n") - 1 - F.col("rank")).alias("nth"), "item", "size")
            gap = swept.where("kind = 1").join(table, (F.col("part") == F.col("g")) & F.col("rank").between(F.col("g0"), F.col("g0") + F.col("n") - 1)).select("run", (F.col("rank") - F.col("g0")).alias("nth"), "bin")
            placed = placed.unionByName(piece.join(gap, ["run", "nth"]).select("item", "size", "bin"))
    return cut(placed)


def best_fit(items: DataFrame, capacity: int, partitions: int | None = None) -> DataFrame:
    """item, bin of every row of ``items`` (item, size), sizes from 1 to ``capacity``, items distinct."""
    spark = items.sparkSession
    state = F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.min("size"), F.max("size")
    n, total, least, largest = items.agg(*state).first()
    done, bins, opened, stuck = [], None, 0, False
    while n:
        parts = partitions or -(-n // SWEEP_ROWS)
        room = bins.where(F.col("gap") >= least).agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0] if bins is not None else 0
        if stuck or total > room:
            fresh = -(-(total if stuck else total - room) // capacity)
            more = spark.range(opened, opened + fresh, 1, parts).select(F.col("id").alias("bin"), F.lit(capacity).cast("bigint").alias("gap"))
            bins, opened = more if bins is None else bins.unionByName(more), opened + fresh
        placed = _round(items, bins.where(F.col("gap") >= least), largest, parts)
        done.append(placed)
        before = n
        items = cut(items.join(placed.select("item"), "item", "left_anti"))
        used = placed.groupBy("bin").agg(F.sum("size").alias("used"))
        bins = cut(bins.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where("gap > 0"))
        n, total, least, largest = items.agg(*state).first()
        stuck = before - n < before / 8
    if not done:
        return items.select("item", F.col("size").alias("bin"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("item", "bin")


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """item, doc_id, piece, first_word, size: every document's pieces; a piece below the capacity is a remainder."""
    n = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\S+")).cast("bigint")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"), n.alias("n")).where("n > 0")
    last = F.floor((F.col("n") - 1) / capacity)
    one = docs.select("doc_id", "key", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    size = F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece") * capacity)
    return one.select("doc_id", "key", "piece", (F.col("piece") * capacity).alias("first_word"), size.alias("size"))


def pack(docs: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """bin_id, doc_id, piece, first_word, n_words, offset: what each bin holds, and where in it.

    Bins of full pieces have negative ids. Words of one document that doesn't exceed the
    capacity are never divided.
    """
    rows = pieces(docs, capacity)
    rows = cut(rows)
    # ids follow the sorted order within partitions, so rows that tie keep one order once written
    rows = cut(rows.repartitionByRange(parts_for(rows.count(), 64), "size", "key", "piece").sortWithinPartitions("size", "key", "piece").withColumn("item", F.monotonically_increasing_id()))
    rest = rows.where(F.col("size") < capacity)
    placed = best_fit(rest.select("item", "size"), capacity, partitions)
    full = rows.where(F.col("size") == capacity).select((-1 - F.col("item")).alias("bin"), "item")
    both = rows.join(placed.select("bin", "item").unionByName(full), "item")
    before = F.expr("coalesce(sum(size) over (partition by bin order by size desc, item rows between unbounded preceding and 1 preceding), 0)")
    return both.select(F.col("bin").alias("bin_id"), "doc_id", "piece", "first_word", F.col("size").alias("n_words"), before.alias("offset"))
