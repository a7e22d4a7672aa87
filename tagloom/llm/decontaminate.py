"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is *contained* in a document if the document holds at least ``threshold`` of the
item's distinct shingles (runs of ``shingle`` words). Jaccard-based MinHash can't see forty
words inside twenty thousand, so both sides are partitioned by size. A document with n
shingles gets one-permutation MinHash signatures whose number of bins is a multiple of n;
which multiple depends on the class of items, those that need few shared shingles getting
denser signatures. A shared shingle is the minimum of its bin with a probability that
depends on the multiple alone, not on the length of the document, so an item that shares
what it needs is missed with a probability below ``MISS`` in every class: items that need
one or two shingles are looked up by all of them. Every bin minimum that is a shingle of
some item of the class makes a candidate; only candidates are then decided by exact
containment of their shingles, compared as text.

Defined cases: null texts and items, and items of fewer than ``MIN_ITEM_WORDS`` words, match
nothing, since a word or two are in any text; an item of fewer words than a shingle is one
shingle of all its words; repeated rows give one result row per distinct id pair (the
largest containment); null ids are kept as null; other columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shipped, sized
from .spans import free_name
from .words import Words, mix, shingle_hashes, signed, slices

SHINGLE, THRESHOLD = 5, 0.5
#: Items whose texts have at most so many bytes are sent to every executor; more are joined by shuffle.
ITEM_BYTES = 16_000_000
#: Items of fewer words say nothing.
MIN_ITEM_WORDS = 3
#: Classes of items: the fewest shared shingles that an item needs, and the bins of a document per shingle; 0: all shingles.
CLASSES = ((1, 0.0), (3, 8.0), (9, 1.0), (33, 0.25))
MISS = 3e-4
_WORD = r"[0-9a-z\u0080-\U0010ffff]+"
_PAIRS = "doc_id bigint, item_id bigint, containment double"


def text_shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    """The distinct shingles of an item; one of fewer than k words is one shingle, one of too few has none."""
    words = re.findall(_WORD, pa.compute.utf8_lower(pa.scalar(text or "")).as_py())
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= MIN_ITEM_WORDS else set()


def need_of(q: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * q - 1e-9))


def class_of(need: np.ndarray) -> np.ndarray:
    """The class of items by the shared shingles that they need."""
    return np.searchsorted([c for c, _ in CLASSES], need, side="right") - 1


def signature(h: np.ndarray, doc: np.ndarray, n_docs: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Bin minima of each document's shingles, as (document, hash); bins by the document's size; all shingles without a factor."""
    if not factor:
        return doc, h
    count = np.bincount(doc, minlength=n_docs)
    bins = np.maximum(1, factor * (1 << np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64))).astype(np.int64)
    bins[count == 0] = 0
    base = np.concatenate([[0], np.cumsum(bins)])
    low = np.full(base[-1], np.iinfo(np.uint64).max, dtype=np.uint64)
    slot = base[doc] + (mix(h ^ np.uint64(0x5BD1E995)) & (bins[doc] - 1).astype(np.uint64)).astype(np.int64)
    np.minimum.at(low, slot, h)
    at = np.flatnonzero(low != np.iinfo(np.uint64).max)
    return np.searchsorted(base, at, side="right") - 1, low[at]


class ItemIndex:
    """Shingles of all items, grouped by shingle length, for lookups in slices of documents."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int, threshold: float):
        self.k, self.threshold = k, threshold
        self.ids = [i for i, _ in items]
        self.shingles = [text_shingles(t, k) for _, t in items]
        words = Words(pa.array([t for _, t in items], pa.string()))
        sizes = np.diff(words.first)
        self.need = np.array([need_of(len(s), threshold) if s else 1 << 30 for s in self.shingles], dtype=np.int64)
        self.by_k: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for kk in sorted({min(k, int(n)) for n in sizes if n >= MIN_ITEM_WORDS}):
            h, at = shingle_hashes(words.hash, words.doc, kk)
            item = words.doc[at]
            own = (np.minimum(sizes[item], k) == kk) & (sizes[item] >= MIN_ITEM_WORDS)
            pairs = np.unique(np.stack([h[own], item[own].astype(np.uint64)]), axis=1)
            hashes, first = np.unique(pairs[0], return_index=True)
            self.by_k[kk] = (hashes, np.append(first, pairs.shape[1]), pairs[1].astype(np.int64))

    def lookup(self, kk: int, values: np.ndarray, bloom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into values, item) of all values that are shingles of items."""
        hashes, first, item = self.by_k[kk]
        may = np.flatnonzero(bloom[(values & np.uint64(len(bloom) - 1)).astype(np.int64)])
        at = np.searchsorted(hashes, values[may])
        at[at == len(hashes)] = 0
        hit = hashes[at] == values[may]
        may, at = may[hit], at[hit]
        n = first[at + 1] - first[at]
        rep = np.repeat(np.arange(len(may)), n)
        inner = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        return may[rep], item[first[at][rep] + inner]

    def bloom(self, kk: int) -> np.ndarray:
        hashes = self.by_k[kk][0]
        size = 1 << max(16, int(np.ceil(np.log2(16 * max(1, len(hashes))))))
        bits = np.zeros(size, dtype=bool)
        bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
        return bits

    def search(self, words: Words, blooms: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        """Candidate (document, item) pairs of a slice, from bin minima, that the shingles of the candidate documents don't refute."""
        out: list[tuple[int, int]] = []
        kind, n_items = class_of(self.need), len(self.ids)
        for kk in self.by_k:
            h, at = shingle_hashes(words.hash, words.doc, kk)
            doc = words.doc[at]
            found = []
            for c in np.unique(kind[self.by_k[kk][2]]).tolist():
                d, low = signature(h, doc, words.n_docs, CLASSES[c][1])
                v, item = self.lookup(kk, low, blooms[kk])
                own = kind[item] == c
                found.append(d[v[own]] * n_items + item[own])
            pairs = np.unique(np.concatenate(found))
            some = np.zeros(words.n_docs, dtype=bool)
            some[pairs // n_items] = True
            sel = np.flatnonzero(some[doc])
            v, item = self.lookup(kk, h[sel], blooms[kk])
            key = doc[sel[v]] * n_items + item
            shared, n = np.unique(np.unique(np.stack([key, signed(h[sel[v]])]), axis=1)[0], return_counts=True)
            at_least = shared[n >= self.need[shared % n_items]]
            out += [(p // n_items, p % n_items) for p in np.intersect1d(pairs, at_least).tolist()]
        return out

    def exact(self, text: str, candidates: list[int]) -> list[tuple[int, float]]:
        own: dict[int, set] = {}
        words = re.findall(_WORD, text)
        out = []
        for i in candidates:
            s = self.shingles[i]
            kk = len(next(iter(s)))
            if kk not in own:
                own[kk] = {tuple(words[j : j + kk]) for j in range(len(words) - kk + 1)}
            got = len(s & own[kk])
            if got >= self.need[i]:
                out.append((i, got / len(s)))
        return out


def _search_all(docs: DataFrame, index: ItemIndex) -> DataFrame:
    index_of = shipped(docs.sparkSession, index)

    def run(batches):
        idx = index_of()
        blooms = {kk: idx.bloom(kk) for kk in idx.by_k}
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1))
                by_doc = defaultdict(list)
                for d, i in idx.search(words, blooms):
                    by_doc[d].append(i)
                rows = [(d, *x) for d, c in by_doc.items() for x in idx.exact(words.lowered[d].as_py(), c)]
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([r[0] for r in rows])), pa.array([idx.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["doc_id", "item_id", "containment"])

    return docs.mapInArrow(run, _PAIRS)


def _keys(table: DataFrame, k: int, threshold: float, of_items: bool) -> DataFrame:
    """(id, key) rows of signatures, for joining documents with too many items to send around."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1))
                size = np.diff(words.first)
                for kk in range(min(k, MIN_ITEM_WORDS), k + 1):
                    h, at = shingle_hashes(words.hash, words.doc, kk)
                    doc = words.doc[at]
                    sides = []
                    if of_items:
                        own = (np.minimum(size[doc], k) == kk) & (size[doc] >= MIN_ITEM_WORDS)
                        d, v = doc[own], h[own]
                        distinct = np.bincount(np.unique(np.stack([d.astype(np.uint64), v]), axis=1)[0].astype(np.int64), minlength=words.n_docs)
                        kind = class_of(np.array([need_of(max(int(x), 1), threshold) for x in distinct]))[d] if len(d) else d
                        sides = [(c, d[kind == c], v[kind == c]) for c in range(len(CLASSES))]
                    else:
                        # an item of fewer words than a shingle needs one, so its class is the first
                        sides = [(c, *signature(h, doc, words.n_docs, f)) for c, (_, f) in enumerate(CLASSES) if kk == k or c == 0]
                    for c, d, v in sides:
                        key = signed(mix(v ^ np.uint64(kk * len(CLASSES) + c) * np.uint64(0x9E3779B97F4A7C15)))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(key)], ["id", "key"])

    return table.mapInArrow(run, "id bigint, key bigint")


def _search_joined(docs: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    keys = _keys(docs, k, threshold, False).alias("d").join(_keys(items, k, threshold, True).distinct().alias("i"), "key")
    pairs = cut(keys.select(F.col("d.id").alias("did"), F.col("i.id").alias("iid")).distinct())
    # only texts of candidates travel: where these are few, their ids are sent to the texts
    few = sized(pairs.select(F.col("did").alias("some")).distinct())
    texts = docs.join(few, F.col("doc_id").eqNullSafe(F.col("some")), "left_semi")
    both = pairs.join(texts, pairs.did.eqNullSafe(texts.doc_id)).join(items.withColumnRenamed("text", "item_text"), F.col("iid").eqNullSafe(F.col("item_id")))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                texts = pa.compute.utf8_lower(part.column(2)).to_pylist()
                for j, (text, item) in enumerate(zip(texts, part.column(3).to_pylist())):
                    idx = ItemIndex([(0, item)], k, threshold)
                    rows += [(j, c) for _, c in (idx.exact(text, [0]) if text and idx.shingles[0] else [])]
                if rows:
                    take = pa.array([r[0] for r in rows])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array([r[1] for r in rows], pa.float64())], ["doc_id", "item_id", "containment"])

    return both.select("doc_id", "item_id", "text", "item_text").mapInArrow(run, _PAIRS)


def contained_items(docs: DataFrame, items: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, containment of all pairs with containment of ``threshold`` or more.

    The size of the items is checked first: up to ``item_bytes`` of text they go to the
    executors once and documents are read, not shuffled; beyond, signatures of both
    sides are joined on their keys and only candidate pairs fetch texts. Candidates are the
    same either way.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    items = items.select(F.col("item_id").cast("bigint"), F.col("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= item_bytes:
        got = items.collect()
        found = _search_all(docs, ItemIndex([(r.item_id, r.text) for r in got], shingle, threshold))
    else:
        found = _search_joined(docs, items, shingle, threshold)
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows with a null id go by whether such a row does."""
    name = free_name("bad_id__", docs.columns)
    bad = sized(cut(contained_items(docs, items, **options).select(F.col("doc_id").cast("bigint").alias(name)).distinct()))
    return docs.join(bad, F.col("doc_id").cast("bigint").eqNullSafe(F.col(name)), "left_anti")
