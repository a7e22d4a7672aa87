"""SimHash near-dedup with May-Ozerov nearest-neighbour recursion.

A document's fingerprint has 256 bits: bit b is the majority over its distinct words of
bit b of the word's hash. Two documents are near copies if their fingerprints differ in
at most ``RADIUS`` bits, which for word sets is a Jaccard similarity of about 0.7.

Pairs are found by the recursion of May and Ozerov (EUROCRYPT 2015). Coordinates are
permuted at random and divided into strips, one per level. At a level, each of
``FILTERS`` filters has a random subset of 32 coordinates of the strip and a random
centre, and keeps the fingerprints whose weight there, relative to the centre, is at
most 11: 5.5 % of unrelated fingerprints, but 36 % of the partners of a kept one at the
radius. Kept lists are filtered again with filters of their own on the next strip, until
unrelated lists would be small; these are compared by brute force. The number of
repetitions follows from the modelled recall of one (``recall_of``), so that a pair at the
radius is found with a probability of ``RECALL`` at least, at any depth; closer ones more
often. No list, bucket or group has a cap.

The first levels are row-local: a fingerprint computes the lists that it reaches, only so
far that a list fits into a task (``LIST_ROWS``), and one shuffle brings each list together;
the other levels, and the comparison, are the task's own. So what is shuffled is a few rows a
fingerprint, and repetitions take turns where it would be more than ``ROUND_ROWS``. A list that
is larger than expected is mostly one group of near copies. All rows close to one of its rows
are linked to that one and dealt among tasks, each of which also gets the list's other rows.

Defined cases: a null or wordless text has no fingerprint, is in no group and is kept;
repeated rows are copies of each other; of a group the row with the smallest id stays
(nulls last, then by a hash of the row); empty tables give empty results; other columns
are untouched whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_for, row_key, sized
from .components import components
from .spans import free_name
from .words import Words, mix, signed, slices

BITS, RADIUS = 256, 48
FILTERS, REPEATS, RECALL = 48, 3, 0.9
SUBSET, WEIGHT, PASS = 32, 11, 0.0551
LEAF, SEED = 1000, 20150426
ROOT_ROWS = 100_000
#: Rows of a list that one task holds; rows a fingerprint that one round shuffles.
LIST_ROWS, ROUND_ROWS = 1_000_000, 24
#: Rows whose bits are unpacked, or held against all filters, at a time.
PORTION = 1 << 15
#: Rows that repeat one kept row, made by one task.
CHUNK = 10_000
_FP = ["f0", "f1", "f2", "f3"]


def spread_table() -> np.ndarray:
    """For each byte value a uint64 whose byte i is bit i of the value, for counting eight bits in one addition."""
    v = np.arange(256, dtype=np.uint64)
    out = np.zeros(256, dtype=np.uint64)
    for b in range(8):
        out |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b)
    return out


def fingerprints_of(words: Words, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, its fingerprint as four uint64) for all documents of a slice that have words."""
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
    shift = np.uint64(44)
    feature = np.unique((words.doc.astype(np.uint64) << shift) | (words.hash >> np.uint64(20)))
    doc = (feature >> shift).astype(np.int64)
    h = feature & ((np.uint64(1) << shift) - np.uint64(1))
    docs, first, n = np.unique(doc, return_index=True, return_counts=True)
    cuts = np.concatenate([np.arange(a, a + c, 255) for a, c in zip(first.tolist(), n.tolist())]) if (n > 255).any() else first
    of = np.searchsorted(cuts, first)
    out = np.zeros((len(docs), 4), dtype=np.uint64)
    for j in range(4):
        with np.errstate(over="ignore"):
            bits = mix(h * np.uint64(2 * j + 3) + np.uint64(0x9E3779B97F4A7C15 & ((1 << 62) - 1)) * np.uint64(j + 1))
        octets = bits.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            part = np.add.reduceat(spread[octets[:, b]], cuts)
            count = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), of, axis=0)
            major = (2 * count > n[:, None]).astype(np.uint64)
            out[:, j] |= (major << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * b)
    return docs, out


def fingerprints(docs: DataFrame) -> DataFrame:
    """key, doc_id and the four parts of the fingerprint, for every row whose text has a word."""

    def run(batches):
        spread = spread_table()
        for batch in batches:
            for part in slices(batch, "text"):
                d, fp = fingerprints_of(Words(part.column(2)), spread)
                take = pa.array(d)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *(pa.array(signed(fp[:, j])) for j in range(4))], ["key", "doc_id", *_FP])

    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "key bigint, doc_id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")


def depth_for(n: int, leaf: int = LEAF) -> int:
    return min(BITS // SUBSET, max(1, math.ceil(math.log(max(n, leaf) / leaf) / -math.log(PASS) - 1e-9)))


def recall_of(depth: int, radius: int = RADIUS, trials: int = 20_000) -> float:
    """Probability that one repetition brings a pair ``radius`` bits apart into one list; modelled, always the same."""
    half = lambda n, k: math.comb(n, k) / 2**n
    # both are within the weight of a random centre, if they differ in k of the subset's coordinates
    both = np.array([sum(half(SUBSET - k, x) * half(k, y) for x in range(SUBSET - k + 1) for y in range(k + 1) if x + max(y, k - y) <= WEIGHT) for k in range(SUBSET + 1)])
    wide = min(64, BITS // depth)
    kept = np.zeros(wide + 1)
    for d in range(wide + 1):
        kept[d] = sum(math.comb(d, k) * math.comb(wide - d, SUBSET - k) * both[k] for k in range(min(d, SUBSET) + 1) if SUBSET - k <= wide - d) / math.comb(wide, SUBSET)
    strips = [wide] * depth + [BITS - wide * depth]
    differ = np.random.default_rng(SEED).multivariate_hypergeometric(strips, radius, size=trials, method="marginals")
    found = np.ones(trials)
    for level in reversed(range(depth)):
        found = 1 - (1 - kept[differ[:, level]] * found) ** FILTERS
    return float(found.mean())


def repeats_for(depth: int) -> int:
    """Repetitions that find ``RECALL`` of the pairs at the radius; ``REPEATS`` and one more per level at least."""
    return max(REPEATS + depth, math.ceil(math.log(1 - RECALL) / math.log(1 - recall_of(depth))))


def strips_of(fp: np.ndarray, depth: int, repeat: int, seed: int) -> np.ndarray:
    """The strips of all fingerprints under the random permutation of a repetition, one uint64 each."""
    order = np.random.default_rng([seed, repeat]).permutation(BITS)
    wide = min(64, BITS // depth)
    out = np.zeros((len(fp), depth), dtype=np.uint64)
    for a in range(0, len(fp), PORTION):
        part = np.ascontiguousarray(fp[a : a + PORTION])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1)[:, order]
        own = np.zeros((len(part), 64), dtype=np.uint8)
        for level in range(depth):
            own[:, :wide] = bits[:, level * wide : (level + 1) * wide]
            out[a : a + PORTION, level] = np.packbits(own, axis=1).view(np.uint64)[:, 0]
    return out


def filters(path: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinate subsets, centres and the ids of the lists of the filters below the list ``path``."""
    with np.errstate(over="ignore"):
        ids = mix(path * np.uint64(0xD6E8FEB86659FD93) + np.arange(1, FILTERS + 1, dtype=np.uint64))
        return pool[(ids >> np.uint64(40)).astype(np.int64) % len(pool)], mix(ids + np.uint64(0x632BE59BD9B4E019)), ids


def pool_of(depth: int, seed: int) -> np.ndarray:
    """The coordinate subsets that filters choose from."""
    wide = min(64, BITS // depth)
    rng = np.random.default_rng([seed, depth])
    own = np.zeros((4096, 64), dtype=np.uint8)
    for row in own:
        row[rng.permutation(wide)[:SUBSET]] = 1
    return np.packbits(own, axis=1).view(np.uint64)[:, 0]


def recurse(strips: np.ndarray, at: np.ndarray, level: int, path: np.uint64, depth: int, pool: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, ids of the lists at ``depth`` that they reach) below the list ``path`` of ``level``, in portions."""
    subset, centre, ids = filters(path, pool)
    passed = [np.nonzero(np.bitwise_count((strips[at[a : a + PORTION], level, None] ^ centre) & subset) <= WEIGHT) for a in range(0, len(at), PORTION)]
    i = np.concatenate([x + k * PORTION for k, (x, _) in enumerate(passed)]) if passed else np.zeros(0, np.int64)
    j = np.concatenate([y for _, y in passed]) if passed else i
    if level + 1 == depth:
        yield at[i], ids[j]
        return
    order = np.argsort(j, kind="stable")
    own = at[i[order]]
    edge = np.append(0, np.cumsum(np.bincount(j, minlength=FILTERS)))
    for k in range(FILTERS):
        if edge[k] < edge[k + 1]:
            yield from recurse(strips, own[edge[k] : edge[k + 1]], level + 1, ids[k], depth, pool)


def root_of(repeat: int, seed: int) -> np.uint64:
    return np.uint64(seed * 64 + repeat)


def paths(fp: np.ndarray, depth: int, repeats: int, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints' indexes, ids of the final lists that they reach), in portions, until all are there."""
    pool = pool_of(depth, seed)
    for r in range(repeats):
        for at, ids in recurse(strips_of(fp, depth, r, seed), np.arange(len(fp)), 0, root_of(r, seed), depth, pool):
            yield at, signed(ids)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of rows of a and b at most ``radius`` bits apart; half of the bits are compared first."""
    left, right = [], []
    for at in range(0, len(a), block):
        x = a[at : at + block]
        d = np.bitwise_count(x[:, None, 0] ^ b[None, :, 0])
        d += np.bitwise_count(x[:, None, 1] ^ b[None, :, 1])
        i, j = np.nonzero(d <= radius)
        far = d[i, j].astype(np.int16) + np.bitwise_count(x[i, 2] ^ b[j, 2]) + np.bitwise_count(x[i, 3] ^ b[j, 3])
        ok = far <= radius
        left.append(i[ok] + at)
        right.append(j[ok])
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def links(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect exactly what all pairs within the radius in a list connect.

    Rows close to one row need no comparison among themselves: they are connected
    through it. So a list that is mostly one group costs its length, not its square.
    """
    left, right = [], []
    rest = np.arange(len(fp))
    while len(rest) > 512:
        best = None
        for p in rest[:: max(1, len(rest) // 8)][:8]:
            near = np.bitwise_count(fp[rest] ^ fp[p]).sum(axis=1) <= radius
            if near.sum() >= 64 and (best is None or near.sum() > best[1].sum()):
                best = (p, near)
        if best is None:
            break
        p, near = best
        ball, rest = rest[near], rest[~near]
        left += [np.full(len(ball), p), None]
        right += [ball, None]
        i, j = close_pairs(fp[ball], fp[rest], radius)
        left[-1], right[-1] = ball[i], rest[j]
    i, j = close_pairs(fp[rest], fp[rest], radius)
    up = i < j
    return np.concatenate([*left, rest[i[up]]]), np.concatenate([*right, rest[j[up]]])


def stars(n: int, left: np.ndarray, right: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest name of its component) for all nodes that a pair connects to a smaller one."""
    label = name.copy()
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != name)
    return name[at], label[at]


_LISTS = "list bigint, cell bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint"
#: The lowest bits of a list's id are the repetition that it belongs to.
_REPEAT = np.uint64(63)


def node_ids(fp: np.ndarray) -> np.ndarray:
    """A node's id, from its fingerprint."""
    out = np.zeros(len(fp), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(4):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + fp[:, j] + np.uint64(j + 1))
    return signed(out)


def _fingerprints_in(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + j).to_numpy(zero_copy_only=False) for j in range(4)], axis=1).view(np.uint64)


def _search(batches, depth: int, split: int, repeats: list[int], seed: int):
    """The lists at level ``split`` that fingerprints reach; small batches are joined, since many rows share the cost of walking through the lists."""
    pool = pool_of(depth, seed)
    got: list[np.ndarray] = []

    def flush():
        fp = np.concatenate(got)
        got.clear()
        for r in repeats:
            strips = strips_of(fp, depth, r, seed)
            for at, ids in recurse(strips, np.arange(len(fp)), 0, root_of(r, seed), split, pool):
                if len(at):
                    where = signed(ids & ~_REPEAT | np.uint64(r))
                    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.zeros(len(at), np.int64)), *(pa.array(signed(fp[at, j])) for j in range(4))], ["list", "cell", *_FP])

    for b in batches:
        if b.num_rows:
            got.append(_fingerprints_in(b, 0))
            if sum(map(len, got)) >= ROOT_ROWS:
                yield from flush()
    if got:
        yield from flush()


def list_links(path: np.uint64, fp: np.ndarray, depth: int, split: int, seed: int, radius: int, pool: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the fingerprints of a list of level ``split``, found by the levels below."""
    if split == depth:
        yield links(fp, radius)
        return
    strips = strips_of(fp, depth, int(path & _REPEAT), seed)
    for at, ids in recurse(strips, np.arange(len(fp)), split, path, depth, pool):
        order = np.argsort(ids, kind="stable")
        at, ids = at[order], ids[order]
        edge = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a > 1:
                left, right = links(fp[at[a:b]], radius)
                yield at[a:b][left], at[a:b][right]


def _compare(batches, depth: int, split: int, seed: int, radius: int):
    pool = pool_of(depth, seed)
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    where, cell = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in (0, 1))
    fp = np.concatenate([_fingerprints_in(b, 2) for b in got])
    del got
    order = np.lexsort((cell, where))
    where, cell, fp = where[order], cell[order], fp[order]
    edge = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]) | (cell[1:] != cell[:-1])) + 1, [len(where)]])
    u, v = [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a < 2:
            continue
        own = fp[a:b]
        name = node_ids(own)
        pairs = [p for p in list_links(where[a : a + 1].view(np.uint64)[0], own, depth, split, seed, radius, pool) if len(p[0])]
        if pairs:
            x, y = stars(b - a, np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), name)
            u.append(x)
            v.append(y)
    if u:
        pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0])), pa.array(np.ascontiguousarray(pairs[1]))], ["u", "v"])


def _bits_apart(prefix: str) -> F.Column:
    return sum((F.bit_count(F.col(f).bitwiseXOR(F.col(prefix + f))) for f in _FP), F.lit(0))


def _name(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(node_ids(_fingerprints_in(b, 4 * k))) for k in (0, 1)], ["u", "v"])


def divided(lists: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Lists of more than ``LIST_ROWS`` rows in cells of about so many, and links that make up for what cells don't compare.

    Of a few rows of such a list the one with most rows close to it becomes its pivot, and
    those rows are linked to it and dealt among cells; among themselves they need no other
    comparison. Every cell has all other rows too. Should these be too many for a cell as
    well, they are dealt likewise, and cells are made for every two portions.
    """
    tries = [F.min(F.struct(F.xxhash64(F.lit(k), *_FP).alias("h"), *_FP)).alias(f"t{k}") for k in range(8)]
    tried = lists.groupBy("list").agg(F.count("*").alias("n"), *tries)
    each = tried.select("list", "n", F.posexplode(F.array(*(F.col(f"t{k}") for k in range(8)))).alias("k", "t")).select("list", "n", "k", *(F.col(f"t.{f}").alias(f"p_{f}") for f in _FP))
    each = cut(each)
    near = lists.join(sized(each), "list").where(_bits_apart("p_") <= radius).groupBy("list", "k").agg(F.count("*").alias("close"))
    best = near.groupBy("list").agg(F.max(F.struct("close", "k")).alias("best")).select("list", F.col("best.k").alias("k"), F.col("best.close").alias("close"))
    pivots = cut(each.join(best, ["list", "k"]).select("list", "n", "close", *(f"p_{f}" for f in _FP)))
    half = max(1, LIST_ROWS // 2)
    parts = lambda c: F.greatest(F.lit(1), F.ceil(c / half)).cast("bigint")
    rows = lists.join(sized(pivots), "list").withColumn("ball", _bits_apart("p_") <= radius).withColumn("k", parts(F.col("close"))).withColumn("m", parts(F.col("n") - F.col("close")))
    share = F.xxhash64(F.lit(77), *_FP)
    up_to = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    mine, own = F.pmod(share, F.col("m")), F.pmod(share, F.col("k"))
    # a cell is a portion of the pivot's rows and one of the others, or two of the others
    of_ball = F.transform(up_to(F.col("m")), lambda i: own * F.col("m") + i)
    of_rest = F.concat(F.transform(up_to(F.col("k")), lambda b: b * F.col("m") + mine), F.transform(up_to(F.col("m")), lambda i: -1 - (F.least(i, mine) * F.col("m") + F.greatest(i, mine))))
    cells = rows.select("list", F.explode(F.when(F.col("ball"), of_ball).otherwise(of_rest)).alias("cell"), *_FP)
    linked = rows.where("ball").select(*_FP, *(f"p_{f}" for f in _FP)).mapInArrow(_name, "u bigint, v bigint").where("u <> v")
    return cells, linked


def split_for(n: int, depth: int, rows: int) -> int:
    """The level at which unrelated lists fit into a task."""
    return next((s for s in range(1, depth) if n * PASS**s <= rows), depth)


def near_edges(nodes: DataFrame, n: int, radius: int = RADIUS, repeats: int | None = None, seed: int = SEED, depth: int | None = None, split: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``nodes`` (f0..f3), ``n`` in number, named by ``node_ids``."""
    depth = depth or depth_for(n)
    split = split or split_for(n, depth, LIST_ROWS)
    repeats = repeats or repeats_for(depth)
    reached = (FILTERS * PASS) ** split
    turn = max(1, int(ROUND_ROWS / reached))
    out = None
    for first in range(0, repeats, turn):
        own = list(range(first, min(first + turn, repeats)))
        lists = nodes.select(*_FP).repartition(max(6, -(-n // ROOT_ROWS))).mapInArrow(lambda b, own=own: _search(b, depth, split, own, seed), _LISTS)
        lists = cut(lists)
        large = cut(lists.groupBy("list").count().where(F.col("count") > LIST_ROWS).select("list"))
        linked = None
        if not large.isEmpty():
            large = sized(large)
            cells, linked = divided(lists.join(large, "list", "left_semi"), radius)
            lists = lists.join(large, "list", "left_anti").unionByName(cells)
        together = lists.repartition(parts_for(max(1, int(n * reached * len(own))), 48, 12_000_000, 6), "list", "cell")
        edges = together.mapInArrow(lambda b: _compare(b, depth, split, seed, radius), "u bigint, v bigint")
        edges = cut((edges.unionByName(linked) if linked is not None else edges).distinct())
        out = edges if out is None else out.unionByName(edges)
    return out


def groups(docs: DataFrame, **options) -> DataFrame:
    """key, doc_id, root, kept_id, kept_key of all rows in groups of two or more.

    The row that stays is found by an aggregation, so no group is gathered in one place.
    """
    sig = cut(fingerprints(docs).select("key", "doc_id", *_FP))
    nodes = cut(sig.groupBy(*_FP).agg(F.count("*").alias("copies")))
    edges = near_edges(nodes, nodes.count(), **options)
    roots = components(edges)
    named = nodes.mapInArrow(_node_rows, "fid bigint, copies bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    named = named.join(roots, F.col("fid") == F.col("node"), "left").where("copies > 1 or root is not null").select(*_FP, F.coalesce("root", "fid").alias("root"))
    member = cut(sig.join(sized(cut(named)), _FP).select("key", "doc_id", "root"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    stays = cut(member.groupBy("root").agg(least.alias("k")).select("root", F.col("k.doc_id").alias("kept_id"), F.col("k.key").alias("kept_key")))
    return member.join(sized(stays), "root")


def _node_rows(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(node_ids(_fingerprints_in(b, 0))), b.column(4), *(b.column(j) for j in range(4))], ["fid", "copies", *_FP])


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, kept_id: each row that goes, and the row of its group that stays."""
    found = groups(docs, **options)
    other = found.where("key <> kept_key").select("doc_id", "kept_id")
    # rows equal to the one that stays, without it
    same = found.where("key = kept_key").groupBy("key", "doc_id", "kept_id").agg(F.count("*").alias("n")).where("n > 1")
    chunks = same.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 2) / CHUNK))).alias("chunk")).repartition("key", "chunk")
    again = chunks.select("doc_id", "kept_id", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n") - 1, (F.col("chunk") + 1) * CHUNK) - 1)).alias("i"))
    return other.unionByName(again.select("doc_id", "kept_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near copies."""
    found = cut(groups(docs, **options))
    gone = sized(cut(found.where("key <> kept_key").select(F.col("key").alias("gone__")).distinct()))
    again = sized(cut(found.where("key = kept_key").groupBy("key").count().where("count > 1").select(F.col("key").alias("again__"))))
    key = free_name("key__", [*docs.columns, "gone__", "again__"])
    gone_id, again_id = free_name("gone__", docs.columns), free_name("again__", docs.columns)
    gone, again = gone.withColumnRenamed("gone__", gone_id), again.withColumnRenamed("again__", again_id)
    keyed = docs.withColumn(key, row_key())
    kept = keyed.join(gone, F.col(key) == F.col(gone_id), "left_anti")
    if not again.isEmpty():
        same = F.col(key) == F.col(again_id)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([key]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
