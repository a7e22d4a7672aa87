"""Suffix-array dedup by bucket-pointer refinement.

Every word position of every text starts a suffix. Suffixes are bucketed by their first
``q`` words; a bucket is refined by the bucket identifiers of a later offset: two
suffixes agree on d + s words (s <= d) if they share the bucket of depth d both at
their own position and s words further on. The identifiers that a refinement gives are
those that the next one reads, until the depth is ``min_words``. A bucket without company
is a suffix that has found its place in the suffix array: only runs of suffixes that all
have company, long enough for a passage, take part in the next refinement. Buckets of the
last depth with two or more members are the passages that repeat; runs of them are reported.

A block is the words of some documents. Of each bucket that occurs in it a block sends the
identifier once, whatever the number of its members, to the range of identifiers that it
belongs to; there buckets with company are told, and the identifiers of those go back to the
blocks. At the last depth a block sends its first member along, in the order of document and
position, and gets back the first of all blocks. So the members of a bucket never meet in one
place: a passage that stands in every document costs a range as many rows as there are blocks.
Identifiers travel sorted, as compressed differences, in fragments of a task's identifiers
for a range. A task makes at most ``FAN`` fragments; where there are more ranges, an exchange
takes several steps, so fragments grow in proportion to the input.

Identifiers are hashes. Those of the first depths are shortened on their way, which can only
let a suffix take part in the next refinement that needn't; at the last depth 96 bits decide.
Texts are read twice, to send identifiers and to bring the blocks to where those that have
company are told; blocks are named by their documents, and a reading that divides the input
otherwise is an error.

Words are runs of letters and digits in lower case. Defined cases: null, empty and
short texts have no suffix of that depth and no result; repeated rows repeat each
other; a text may repeat itself, also with overlap; null ids are kept and come last; rows
that share an id come in the order of a hash of their texts; empty tables
give empty results; other columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, shingle_hashes, slices

MIN_WORDS, Q = 50, 13
BLOCK_WORDS = 2_000_000
#: Words whose identifiers a partition holds; with arrays of them this is about 150 MB.
PART_WORDS = 4_000_000
FAN = 512
_ROW = "to int, kind int, block bigint, n bigint, data binary"
_STATE, _ITEMS = 0, 1
_U = np.uint64
#: Columns of what is sent: of every depth but the last, of the last, and of the answer to that.
_PLAIN = (np.uint64, np.int64)
_FIRST = (np.uint64, np.int64, np.uint32, np.uint8, np.int64, np.uint16, np.uint32)
_SOURCE = (np.uint64, np.int64, np.uint8, np.uint8, np.int64, np.uint16, np.uint32)


def encode(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane, compressed."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def decode(data: bytes, n: int, *types) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    out, at = [], 0
    for t in types:
        wide = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(t)[:, 0])
        at += n * wide
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[1:] -= x[:-1]
    return out


@dataclass(frozen=True)
class Route:
    """How what is meant for one of ``parts`` partitions gets there in steps of at most ``fan`` fragments a task."""

    parts: int
    fan: int = FAN

    @property
    def steps(self) -> int:
        n = 1
        while self.fan**n < self.parts:
            n += 1
        return n

    def to(self, part: np.ndarray, step: int, task: int) -> np.ndarray:
        """Where things go in a step; in all but the last, tasks that send to one group of partitions divide it among them."""
        if step == self.steps:
            return part
        width = self.fan ** (self.steps - step)
        spread = max(1, self.parts // -(-self.parts // width))
        return part // width * spread + task % spread

    def home(self, block: np.ndarray) -> np.ndarray:
        return (mix(block.astype(np.int64).view(_U)) % _U(self.parts)).astype(np.int64)

    def range(self, key: np.ndarray, bits: int) -> np.ndarray:
        """The range of an identifier of so many bits, from its upper ones."""
        top = key >> _U(max(0, bits - 32))
        return (top * _U(self.parts) >> _U(min(bits, 32))).astype(np.int64)


def _batches(rows: list[tuple]):
    for k in range(0, len(rows), 64):
        to, kind, block, n, data = zip(*rows[k : k + 64])
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["to", "kind", "block", "n", "data"])


def fragments(route: Route, step: int, task: int, columns: list[np.ndarray], bits: int | None) -> list[tuple]:
    """Rows that carry items (identifier, block, ...) a step on: to the ranges of identifiers of ``bits`` bits, or home to the blocks."""
    key, block = columns[:2]
    if not len(key):
        return []
    part = route.home(block) if bits is None else route.range(key, bits)
    order = np.lexsort((key, block, part)) if bits is None else np.argsort(key)
    to = route.to(part[order], step, task)
    edge = [*np.flatnonzero(np.append(True, np.diff(to) != 0)).tolist(), len(to)]
    columns = [c[order] for c in columns]
    return [(int(to[a]), _ITEMS, -1, b - a, encode(deltas(columns[0][a:b]), deltas(columns[1][a:b]), *(c[a:b] for c in columns[2:]))) for a, b in zip(edge, edge[1:])]


class _Received:
    """What a partition got: states as they came, and all items in one array a column."""

    def __init__(self, batches, types):
        self.states: list[tuple[int, int, bytes]] = []
        got = []
        for b in batches:
            for kind, block, n, data in zip(*(b.column(c).to_pylist() for c in range(1, 5))):
                if kind == _STATE:
                    self.states.append((block, n, data))
                else:
                    columns = decode(data, n, *types)
                    got.append([np.cumsum(columns[0], dtype=_U), np.cumsum(columns[1], dtype=np.int64), *columns[2:]])
        self.items = [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, t) for t in types]

    def moved(self, route: Route, step: int, task: int) -> list[tuple]:
        return [(int(route.to(route.home(np.array([block])), step, task)[0]), _STATE, block, n, data) for block, n, data in self.states]


class Block:
    """Segments of a block's documents that may hold passages, and its documents."""

    _DOC = (np.uint8, np.int64, np.uint16, np.int64)

    def __init__(self, null, doc, text, first, start, size, words):
        #: Of each document: whether its id is null, the id, a hash of its text, its first position in the block.
        self.null, self.doc, self.text, self.first = null, doc, text, first
        #: Of each segment: its first position in the block and its number of words; the words of all segments.
        self.start, self.size, self.words = start, size, words

    def pack(self) -> bytes:
        names, rank = np.unique(self.words, return_inverse=True)
        parts = [encode(self.null, self.doc, self.text, self.first), encode(deltas(self.start), self.size), encode(deltas(names)), encode(rank.astype(np.uint32))]
        head = np.array([len(self.doc), len(self.start), len(names), len(rank), *map(len, parts)], dtype=np.int64)
        return head.tobytes() + b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        head = np.frombuffer(data[:64], dtype=np.int64).tolist()
        at, parts = 64, []
        for n in head[4:]:
            parts.append(data[at : at + n])
            at += n
        start, size = decode(parts[1], head[1], np.int64, np.int64)
        names = np.cumsum(decode(parts[2], head[2], _U)[0], dtype=_U)
        return cls(*decode(parts[0], head[0], *cls._DOC), np.cumsum(start), size, names[decode(parts[3], head[3], np.uint32)[0]])

    def buckets(self, depths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, index among the segments' words and identifier of every suffix of the last depth."""
        segment = np.repeat(np.arange(len(self.size)), self.size)
        key, at = shingle_hashes(self.words, segment, depths[0])
        for d, deeper in zip(depths, depths[1:]):
            shift = deeper - d
            later = np.searchsorted(at, at + shift)
            later[later == len(at)] = 0
            ok = np.flatnonzero((at[later] == at + shift) & (segment[at[later]] == segment[at]))
            with np.errstate(over="ignore"):
                key, at = mix(mix(key[ok] + _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93) + key[later[ok]]), at[ok]
        return segment[at], at, key

    def position(self, segment: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The position in the block of words of segments."""
        return self.start[segment] + at - (np.cumsum(self.size) - self.size)[segment]

    def kept(self, depths: list[int], shared: np.ndarray, min_words: int) -> Block:
        """The block with the runs of suffixes with company that may hold a passage."""
        segment, at, _ = self.buckets(depths)
        segment, at = segment[shared], at[shared]
        new = np.append(True, (np.diff(at) != 1) | (np.diff(segment) != 0)) if len(at) else np.zeros(0, bool)
        a = np.flatnonzero(new)
        n = np.diff(np.append(a, len(at))) + depths[-1] - 1
        a, n = a[n >= min_words], n[n >= min_words]
        inner = np.repeat(at[a] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = self.position(segment[a], at[a])
        used = np.unique(np.searchsorted(self.first, start, side="right") - 1)
        return Block(self.null[used], self.doc[used], self.text[used], self.first[used], start, n, self.words[inner])

    def documents(self, segment: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, self.start[segment], side="right") - 1


def _short(key: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of identifiers."""
    return key >> _U(64 - bits)


def _blocks(batches, min_words: int):
    """(name, block) of a task's documents that are long enough for a passage; the name tells the block's place and documents."""
    task, seq, words = 0, 0, 0
    docs, start, size, hashes = [], [], [], []

    def made():
        nonlocal seq, words
        null, ids, text, whole = (np.concatenate([d[k] for d in docs]) for k in range(4))
        with np.errstate(over="ignore"):
            name = mix(np.array([task << 24 | seq], _U) + mix(whole.view(_U) + np.arange(len(whole), dtype=_U)).sum(dtype=_U))
        first = np.concatenate(start)
        out = int(name.view(np.int64)[0]), Block(null, ids, text, first, first, np.concatenate(size), np.concatenate(hashes))
        seq, words = seq + 1, 0
        docs.clear(), start.clear(), size.clear(), hashes.clear()
        return out

    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part.column(2))
            n = np.diff(w.first)
            task = part.column(3)[0].as_py()
            long = np.flatnonzero(n >= min_words)
            if not len(long):
                continue
            ids = part.column(0)
            null = np.array([ids[int(i)].as_py() is None for i in long], dtype=np.uint8)
            known = np.array([ids[int(i)].as_py() or 0 for i in long], dtype=np.int64)
            whole = part.column(1).to_numpy()[long]
            docs.append((null, known, (whole.view(_U) >> _U(48)).astype(np.uint16), whole))
            own = np.repeat(n >= min_words, n)
            start.append(words + np.cumsum(n[long]) - n[long])
            size.append(n[long])
            hashes.append(w.hash[own])
            words += int(n[long].sum())
            if words >= BLOCK_WORDS:
                yield made()
    if words:
        yield made()


def _identifiers(batches, route: Route, depths: list[int], bits: int, min_words: int):
    """The identifiers of each block's buckets, once each."""
    task = TaskContext.get().partitionId()
    for name, block in _blocks(batches, min_words):
        key = np.unique(_short(block.buckets(depths)[2], bits))
        yield from _batches(fragments(route, 1, task, [key, np.full(len(key), name)], bits))


def _states(batches, route: Route, min_words: int):
    """The blocks themselves."""
    task = TaskContext.get().partitionId()
    for name, block in _blocks(batches, min_words):
        yield from _batches([(int(route.to(route.home(np.array([name])), 1, task)[0]), _STATE, name, 0, block.pack())])


def _relay(batches, route: Route, step: int, types, bits: int | None):
    """Takes what is on its way a step further."""
    task = TaskContext.get().partitionId()
    got = _Received(batches, types)
    yield from _batches([*got.moved(route, step, task), *fragments(route, step, task, got.items, bits)])


def _company(batches, route: Route):
    """Back to the blocks: the identifiers that two blocks or more have sent."""
    task = TaskContext.get().partitionId()
    got = _Received(batches, _PLAIN)
    order = np.argsort(got.items[0], kind="stable")
    key, block = (c[order] for c in got.items)
    same = key[1:] == key[:-1]
    shared = np.append(same, False) | np.append(False, same) if len(key) else np.zeros(0, bool)
    yield from _batches([*got.moved(route, 1, task), *fragments(route, 1, task, [key[shared], block[shared]], None)])


def _by_block(got: _Received):
    """(block, its state, the numbers of its items) of a partition of blocks."""
    order = np.argsort(got.items[1], kind="stable")
    block = got.items[1][order]
    if not set(np.unique(block).tolist()) <= {name for name, _, _ in got.states}:
        raise RuntimeError("the documents changed, or were divided otherwise, between two readings")
    for name, _, data in sorted(got.states, key=lambda s: s[0]):
        a, b = np.searchsorted(block, name), np.searchsorted(block, name, side="right")
        yield name, Block.unpack(data), order[a:b]


def _with_company(key: np.ndarray, bits: int, sent: np.ndarray) -> np.ndarray:
    """Which suffixes have company in other blocks, as was sent, or in their own."""
    short = _short(key, bits)
    sent = np.sort(sent)
    at = np.minimum(np.searchsorted(sent, short), max(len(sent) - 1, 0))
    order = np.argsort(short)
    same = short[order][1:] == short[order][:-1]
    own = np.zeros(len(key), bool)
    own[order] = np.append(same, False) | np.append(False, same) if len(key) else own
    return own | (sent[at] == short) if len(sent) else own


def _firsts(block: Block, depths: list[int]) -> tuple[np.ndarray, ...]:
    """Of all suffixes: document, position in it, identifier, check; the order by identifier, then document and position, and where each identifier begins in it."""
    segment, at, key = block.buckets(depths)
    doc = block.documents(segment)
    pos = block.position(segment, at) - block.first[doc]
    pieces = np.repeat(np.arange(len(block.size)), block.size)
    check, _ = shingle_hashes(mix(block.words ^ _U(0xA0761D6478BD642F)), pieces, depths[-1])
    order = np.lexsort((pos, doc, block.text[doc], block.doc[doc], block.null[doc], key))
    new = np.flatnonzero(np.append(True, np.diff(key[order].view(np.int64)) != 0)) if len(key) else np.zeros(0, np.int64)
    return doc, pos, key, (check >> _U(32)).astype(np.uint32), order, new


def _refine(batches, route: Route, depths: list[int], bits: int, min_words: int, last: bool):
    """From buckets with company at a depth to the identifiers of the next, which is read through the pointers of this."""
    task = TaskContext.get().partitionId()
    got = _Received(batches, _PLAIN)
    for name, block, own in _by_block(got):
        shared = _with_company(block.buckets(depths[:-1])[2], bits, got.items[0][own])
        block = block.kept(depths[:-1], shared, min_words)
        if not len(block.size):
            continue
        home = int(route.to(route.home(np.array([name])), 1, task)[0])
        if last:
            doc, pos, key, check, order, new = _firsts(block, depths)
            f = order[new]
            d = doc[f]
            items = [key[f], np.full(len(f), name), check[f], block.null[d], block.doc[d], block.text[d], pos[f].astype(np.uint32)]
        else:
            key = np.unique(_short(block.buckets(depths)[2], bits))
            items = [key, np.full(len(key), name)]
        yield from _batches([(home, _STATE, name, 0, block.pack()), *fragments(route, 1, task, items, 64 if last else bits)])


def _sources(batches, route: Route):
    """Back to the blocks: of each bucket with members in two blocks or more the first member, and whether it is the block's own."""
    task = TaskContext.get().partitionId()
    got = _Received(batches, _FIRST)
    key, block, check, null, doc, text, pos = got.items
    order = np.lexsort((block, pos, text, doc, null, check, key))
    new = np.append(True, (np.diff(key[order].view(np.int64)) != 0) | (np.diff(check[order].astype(np.int64)) != 0)) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    shared = np.repeat(size > 1, size)
    of = order[np.repeat(first, size)][shared]
    own = order[shared]
    items = [key[own], block[own], (own == of).astype(np.uint8), null[of], doc[of], text[of], pos[of]]
    yield from _batches([*got.moved(route, 1, task), *fragments(route, 1, task, items, None)])


_RESULT = "doc_id bigint, start_word bigint, n_words bigint, source_id bigint, source_word bigint, is_source boolean"


def _runs(batches, depths: list[int]):
    """Runs of repeated positions with one source."""
    got = _Received(batches, _SOURCE)
    for _, block, own in _by_block(got):
        doc, pos, key, _, order, new = _firsts(block, depths)
        if not len(key):
            continue
        size = np.diff(np.append(new, len(order)))
        local = key[order[new]]
        # the source of each bucket: the first of the block's own members, unless another block's comes before
        f = order[new]
        src = [block.null[doc[f]], block.doc[doc[f]], block.text[doc[f]], pos[f].astype(np.int64)]
        mine = np.ones(len(new), bool)
        several = size > 1
        if len(own):
            at = np.searchsorted(local, got.items[0][own])
            several[at] = True
            mine[at] = got.items[2][own] == 1
            for k, c in enumerate((3, 4, 5, 6)):
                src[k][at] = got.items[c][own]
        of = np.repeat(np.arange(len(new)), size)
        source = np.zeros(len(order), bool)
        source[new] = mine
        take = several[of]
        back = np.lexsort((pos[order][take], doc[order][take]))
        of, source, at = of[take][back], source[take][back], order[take][back]
        d, p = doc[at], pos[at]
        s_null, s_doc, s_text, s_pos = (c[of] for c in src)
        cut = np.append(True, (np.diff(d) != 0) | (np.diff(p) != 1) | (np.diff(s_null) != 0) | (np.diff(s_doc) != 0) | (np.diff(s_text) != 0) | (np.diff(s_pos) != 1) | (source[1:] != source[:-1])) if len(at) else np.zeros(0, bool)
        a = np.flatnonzero(cut)
        n = np.diff(np.append(a, len(at))) + depths[-1] - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.doc[d[a]], mask=block.null[d[a]].astype(bool)), pa.array(p[a]), pa.array(n), pa.array(s_doc[a], mask=s_null[a].astype(bool)), pa.array(s_pos[a]), pa.array(source[a])],
            [f.split()[0] for f in _RESULT.split(", ")],
        )


def depths_of(min_words: int, q: int) -> list[int]:
    """The depths of the refinements: twice the one before, until it is ``min_words``."""
    out = [q]
    while out[-1] < min_words:
        out.append(min(2 * out[-1], min_words))
    return out if len(out) > 1 else [q, q]


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, q: int = Q, partitions: int | None = None, fan: int = FAN) -> DataFrame:
    """doc_id, start_word, n_words, source_id, source_word, is_source of every passage that repeats.

    A passage has ``min_words`` or more words; its source is the occurrence that comes first
    in the order of ids and positions, whatever the division of the input. Every occurrence
    is reported; removing those that aren't sources leaves one copy of every passage. Where
    the sources of a passage's parts differ, the parts are reported separately and overlap by
    ``min_words`` - 1 words.
    """
    if not 0 < q <= min_words:
        raise ValueError("q must be from 1 to min_words")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("task"))
    words = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6 + 1
    route = Route(partitions or max(1, -(-words // PART_WORDS)), fan)
    # where one in 64 identifiers has company by chance, runs of them that are long enough for a passage still don't
    bits = min(60, words.bit_length() + 6)
    depths = depths_of(min_words, q)

    def sent(rows: DataFrame, types, bits: int | None) -> DataFrame:
        rows = rows.repartitionById(route.parts, F.col("to"))
        for step in range(2, route.steps + 1):
            rows = rows.mapInArrow(lambda b, s=step: _relay(b, route, s, types, bits), _ROW).repartitionById(route.parts, F.col("to"))
        return rows

    # texts are read twice, since blocks would otherwise travel with the identifiers and back
    rows = sent(docs.mapInArrow(lambda b: _identifiers(b, route, depths[:1], bits, min_words), _ROW), _PLAIN, bits)
    states = docs.mapInArrow(lambda b: _states(b, route, min_words), _ROW)
    for k in range(2, len(depths) + 1):
        last = k == len(depths)
        rows = rows.mapInArrow(lambda b: _company(b, route), _ROW)
        rows = sent(rows.unionByName(states) if k == 2 else rows, _PLAIN, None)
        rows = rows.mapInArrow(lambda b, k=k, last=last: _refine(b, route, depths[:k], bits, min_words, last), _ROW)
        rows = sent(rows, _FIRST if last else _PLAIN, 64 if last else bits)
    rows = sent(rows.mapInArrow(lambda b: _sources(b, route), _ROW), _SOURCE, None)
    return rows.mapInArrow(lambda b: _runs(b, depths), _RESULT)
