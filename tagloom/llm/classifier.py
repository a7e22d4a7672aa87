"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded from the
summed log odds of its hashed words and word beginnings (those that differ significantly
between good and other documents) and from statistics of its characters; the gated
attention of Ilse, Tomczak and Welling (2018) weighs the passages,
a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))), and a logistic unit scores sum a_k h_k.
Only documents have labels: a document is good if its quality is 1 and it isn't toxic.
The attention learns from these alone which passage decides, so that one bad passage in
a long text isn't averaged away.

Training takes place on the driver, on a sample of at most ``TRAIN_ROWS`` labelled
documents, those with the smallest hashes of their ids whatever the input's size, whole
texts of at most ``TRAIN_BYTES`` together. The shortest of each kind come first, and texts
of more than a hundredth of these bytes last, so that a few long ones don't take the place
of all others. Every passage of every whole text is scored.

Defined cases: a text without words has no passage, scores 0 and is rejected; rows with
null ids or repeated ids are scored as the others; of repeated labels the worst counts,
null labels count as good; without labelled texts of both kinds nothing can be told
apart, so every text with words scores 1; empty tables give empty results; other columns
are untouched whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shipped
from .spans import free_name
from .words import Words, buffer_of, slices

PASSAGE, BUCKETS, BEGINNING, HIDDEN, ATTENTION = 64, 1 << 18, 5, 16, 12
DIM, SIGNIFICANT = 4, 5.0
LONG_SHARE = 100
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, KEEP_AT = 8000, 32_000_000, 20, 0.5
STATS = 14


class Passages:
    """Passages of a slice: word buckets, passage of each word, passage statistics, first passage of each row."""

    __slots__ = ("bucket", "begin", "word_first", "stats", "first", "doc")

    def __init__(self, column: pa.Array):
        words = Words(column)
        size = np.diff(words.first)
        n = -(-size // PASSAGE)
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.doc = np.repeat(np.arange(words.n_docs), n)
        nth = np.arange(self.first[-1]) - self.first[self.doc]
        self.word_first = words.first[self.doc] + nth * PASSAGE
        # two entries a word: of the whole and, in the table's other half, of its beginning, which inflected forms share
        half = np.uint64(BUCKETS // 2 - 1)
        self.bucket = (words.hash & half).astype(np.int32)
        self.begin = (words.beginnings(BEGINNING) & half).astype(np.int32) + np.int32(BUCKETS // 2)
        raw, off = buffer_of(column)
        # Lower-casing may change a text's length in bytes; where it does, only its last passages' bounds shift.
        begin = np.minimum(words.start[self.word_first] if len(self.word_first) else self.word_first, max(len(raw) - 1, 0))
        begin = np.where(nth == 0, off[:-1][self.doc], begin)
        self.stats = np.zeros((len(begin), STATS), dtype=np.float32)
        if not len(begin):
            return
        begin = np.maximum.accumulate(begin)
        end = np.append(begin[1:], len(raw))
        long = np.maximum(end - begin, 1).astype(np.float32)
        kind = np.full(256, 7, dtype=np.int32)
        kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
        kind[[9, 13, 32]], kind[10], kind[128:] = 3, 4, 5
        kind[[ord(c) for c in ".,;:'\"?()-"]] = 6
        kind[ord("!")], kind[ord("|")] = 8, 9
        of = np.repeat(np.arange(0, len(begin) * 10, 10, dtype=np.int32), end - begin) + kind[raw[begin[0] : end[-1]]]
        self.stats[:, :10] = np.bincount(of, minlength=len(begin) * 10).reshape(-1, 10) / long[:, None]
        count = np.diff(np.append(self.word_first, len(words.hash)))
        pair = np.unique((np.repeat(np.arange(len(count)), count).astype(np.uint64) << np.uint64(40)) | (words.hash >> np.uint64(24)))
        self.stats[:, 10] = np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=len(count)) / count
        same = np.concatenate([[0], np.cumsum(np.append(words.hash[1:] == words.hash[:-1], False))])
        self.stats[:, 11] = (same[self.word_first + count] - same[self.word_first]) / count
        self.stats[:, 12] = long / count / 10
        self.stats[:, 13] = np.log1p(count) / 5


def log_odds(bags: list[Passages], good: np.ndarray, batch: int) -> np.ndarray:
    """For every bucket the significant log odds of documents that aren't good: (positive part, negative part)."""
    n = np.zeros((2, BUCKETS))
    for b, x in enumerate(bags):
        count = np.diff(np.append(x.word_first, len(x.bucket)))
        doc = np.repeat(x.doc, count).astype(np.int64)
        for buckets in (x.bucket, x.begin):
            pair = np.unique(doc * BUCKETS + buckets)
            own = good[b * batch + pair // BUCKETS]
            for y in (0, 1):
                n[y] += np.bincount((pair % BUCKETS)[own == y], minlength=BUCKETS)
    share = (good == 0).mean()
    total = n.sum(axis=0)
    z = (n[0] - total * share) / np.sqrt(np.maximum(total, 1) * share * (1 - share) + 1e-9)
    odds = np.log((n[0] + 3 * share) / (n[1] + 3 * (1 - share)) * (1 - share) / share)
    odds = np.where(np.abs(z) >= SIGNIFICANT, odds, 0)
    return np.stack([np.maximum(odds, 0), np.maximum(-odds, 0)], axis=1).astype(np.float32)


class Model:
    """The encoder's table and the network's weights; ``score`` runs it, ``fit`` trains it with Adam."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.odds = np.zeros((BUCKETS, 2), np.float32)
        self.p = {"W": g(DIM + STATS, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": g(HIDDEN, ATTENTION), "U": g(HIDDEN, ATTENTION), "w": g(ATTENTION), "c": g(HIDDEN), "d": np.zeros(1, np.float32)}
        self.mean, self.dev = np.zeros(STATS, np.float32), np.ones(STATS, np.float32)

    def encode(self, x: Passages) -> np.ndarray:
        if not len(x.word_first):
            return np.zeros((0, DIM + STATS), np.float32)
        odds = np.concatenate([np.add.reduceat(self.odds[b], x.word_first, axis=0) for b in (x.bucket, x.begin)], axis=1)
        return np.concatenate([np.log1p(odds), np.clip((x.stats - self.mean) / self.dev, -8, 8)], axis=1)

    def forward(self, x: Passages, z: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = np.exp(np.clip((t * s) @ p["w"], -15, 15))
        docs = np.unique(x.doc)
        at = x.first[docs]
        total = np.add.reduceat(a, at) if len(at) else a
        size = x.first[docs + 1] - at
        a = a / np.repeat(total, size)
        m = np.add.reduceat(a[:, None] * h, at, axis=0) if len(at) else np.zeros((0, HIDDEN), np.float32)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "docs": docs, "at": at, "size": size, "m": m, "y": y}

    def score(self, x: Passages) -> np.ndarray:
        out = np.zeros(len(x.first) - 1)
        f = self.forward(x, self.encode(x))
        out[f["docs"]] = f["y"]
        return out

    def gradient(self, x: Passages, f: dict, good: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        dy = ((f["y"] - good[f["docs"]]) * weight[f["docs"]] / len(f["docs"])).astype(np.float32)
        g = {"c": f["m"].T @ dy, "d": np.array([dy.sum()], np.float32)}
        dm = np.repeat(dy[:, None] * p["c"], f["size"], axis=0)
        dh = f["a"][:, None] * dm
        da = (dm * f["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["a"] * da, f["at"]), f["size"])
        dl = f["a"] * (da - mean)
        g["w"] = (f["t"] * f["s"]).T @ dl
        dt = dl[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = dl[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh += dt @ p["V"].T + ds @ p["U"].T
        dz = dh * (1 - f["h"] ** 2)
        g["W"], g["b"] = f["z"].T @ dz, dz.sum(axis=0)
        return g

    def fit(self, texts: list[str], good: list[int], epochs: int = EPOCHS, batch: int = 64, seed: int = 5) -> Model:
        """The network learns each half of the documents with the log odds of the other, so that these don't flatter it; scores use those of all."""
        order = np.random.default_rng(seed).permutation(len(good))
        y = np.asarray(good, dtype=np.float32)[order]
        middle = -(-len(y) // (2 * batch)) * batch
        bags = [Passages(pa.array([texts[i] for i in order[k : k + batch]], pa.string())) for k in range(0, len(y), batch)]
        halves = (slice(0, middle // batch), slice(middle // batch, len(bags)))
        labels = (y[:middle], y[middle:])
        share = min(max(float(y.mean()), 0.02), 0.98)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        stats = np.concatenate([b.stats for b in bags])
        self.mean, self.dev = stats.mean(axis=0), stats.std(axis=0) + 1e-3
        codes: list[np.ndarray] = []
        for own, other in ((0, 1), (1, 0)):
            if len(labels[other]):
                self.odds = log_odds(bags[halves[other]], labels[other], batch)
            codes += [self.encode(b) for b in bags[halves[own]]]
        self.odds = log_odds(bags, y, batch)
        (m1, m2), step = [{k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)], 0
        rng = np.random.default_rng(seed)
        for epoch in range(epochs):
            for b in rng.permutation(len(bags)):
                if not len(codes[b]):
                    continue
                f = self.forward(bags[b], codes[b])
                g = self.gradient(bags[b], f, y[b * batch : (b + 1) * batch], weight[b * batch : (b + 1) * batch])
                step += 1
                for k, v in self.p.items():
                    m1[k] += 0.1 * (g[k] - m1[k])
                    m2[k] += 0.01 * (g[k] ** 2 - m2[k])
                    v -= 0.01 / (1 + 0.3 * epoch) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
        return self


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, good of at most ``rows`` labelled documents, chosen by the hashes of their ids."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) <= 0) | (F.coalesce(F.col("toxic"), F.lit(0)) > 0)
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id__")).agg(F.min(F.when(bad, 0).otherwise(1)).alias("good__"))
    chosen = of.orderBy(F.xxhash64("id__"), "id__").limit(rows)
    text = docs.select(F.col("doc_id").cast("bigint").alias("id__"), F.col("text").cast("string").alias("text__"))
    # the chosen ids are bounded by ``rows``, so they can be sent to every executor, and the window holds no more rows
    got = text.join(F.broadcast(chosen), "id__").groupBy("id__", "good__").agg(F.min("text__").alias("text__"))
    size, by_hash = F.octet_length("text__"), (F.xxhash64("id__"), F.col("id__"))
    nth = F.row_number().over(Window.partitionBy("good__").orderBy(F.coalesce(size, F.lit(0)) == 0, size, *by_hash))
    # the shortest of each kind, then by hash, then long texts by length: what doesn't fit never keeps out what does
    last = F.when(nth == 1, -1).when(size > TRAIN_BYTES // LONG_SHARE, size).otherwise(0)
    total = F.sum(size).over(Window.orderBy("last__", *by_hash))
    return got.withColumn("last__", last).withColumn("total__", total).where(F.col("total__") <= TRAIN_BYTES).orderBy("id__").select(F.col("text__").alias("text"), F.col("good__").alias("good"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> Model | None:
    """The model of the sample's labels; None where labelled texts aren't of both kinds."""
    got = [(r.text, r.good) for r in training_sample(docs, labels, rows).collect() if r.text]
    if len({g for _, g in got}) < 2:
        return None
    return Model().fit([t for t, _ in got], [g for _, g in got], epochs)


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1."""
    if model is None:
        return docs.withColumn(name, F.when(F.lower("text").rlike(r"[0-9a-z\x{80}-\x{10FFFF}]"), 1.0).otherwise(0.0))
    model_of = shipped(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches):
        network = model_of()
        for batch in batches:
            for part in slices(batch, "text"):
                y = network.score(Passages(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(y)], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, score of all documents."""
    return scored(_narrow(docs), train(docs, labels, **options)).select("doc_id", "score")


def accepted(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, **options) -> DataFrame:
    """doc_id, score of the documents that the classifier accepts."""
    return quality_scores(docs, labels, **options).where(F.col("score") >= keep_at)


def drop_rejected(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    name = free_name("score__", docs.columns)
    return scored(docs, train(docs, labels, **options), name).where(F.col(f"`{name}`") >= keep_at).drop(name)
