"""Quality rules by distribution divergence.

Two histograms of a document are compared with references of its language by
Jensen-Shannon distance, to base 2 (0: equal, 1: disjoint): that of character classes,
and that of the language's ``COMMON`` most frequent words plus all others together. The
references are the counts of the whole corpus, per language, whatever the language's size;
a document counts in the reference that it is compared with. A document is kept if
neither distance exceeds its limit, or if it is too short to be judged: below
``MIN_CHARS`` characters or ``MIN_WORDS`` words the histograms say nothing.

Defined cases: null and empty texts are short, so they stay, with null distances;
null languages are one language of their own; ties among common words go to the
smaller word; repeated rows count and are judged separately; empty tables give empty
results; other columns are untouched whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sized
from .words import Words, buffer_of, slices

COMMON, MIN_CHARS, MIN_WORDS = 40, 200, 30
CHAR_LIMIT, WORD_LIMIT = 0.245, 0.447
#: Different words that a task counts before it sends them on.
TASK_WORDS = 1_000_000
#: Marks a class among words; no word begins with it.
_CLASS = "\0"
#: Languages, about a kilobyte each, whose references are sent to every executor.
MAX_SENT = 50_000
CLASSES = ("lower", "upper", "digit", "space", "newline", "punctuation", "beyond_ascii", "other")
PUNCTUATION = ".,;:'\"?()-"


def class_counts(column: pa.Array) -> np.ndarray:
    """Characters of each class, by row; bytes that continue a character count as none."""
    raw, off = buffer_of(column)
    kind = np.full(256, 7, dtype=np.int64)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[9, 13, 32]], kind[10] = 3, 4
    kind[[ord(c) for c in PUNCTUATION]] = 5
    kind[192:], kind[128:192] = 6, 8
    row = np.repeat(np.arange(len(off) - 1) * 9, np.diff(off))
    return np.bincount(row + kind[raw], minlength=9 * (len(off) - 1)).reshape(-1, 9)[:, :8]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of counts p from the counts q, to base 2: the root of the divergence."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _lang() -> F.Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def _strings(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings between byte positions of a buffer."""
    size = end - begin
    off = np.append(0, np.cumsum(size))
    at = np.repeat(begin - off[:-1], size) + np.arange(off[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[at])))


def _counts(batches):
    """Words and classes of each language with their counts, summed in the task as far as memory allows."""
    names = ["ref_lang", "word", "n"]
    got: list[pa.RecordBatch] = []
    rows = 0

    def add(lang: str, words: pa.Array, n: np.ndarray):
        nonlocal rows
        got.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(words)).dictionary_encode(), words, pa.array(n, pa.int64())], names))
        rows += len(words)

    def summed() -> pa.Table:
        nonlocal rows
        table = pa.Table.from_batches(got).unify_dictionaries().group_by(names[:2]).aggregate([("n", "sum")]).rename_columns(names)
        rows = 0
        got.clear()
        return table

    def sent(table: pa.Table):
        for b in table.combine_chunks().to_batches(100_000):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), b.column(2)], names)

    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column(1))
            raw, _ = buffer_of(words.lowered)
            code = part.column(0).dictionary_encode()
            of = code.indices.to_numpy(zero_copy_only=False)
            each = class_counts(part.column(1))
            for k, lang in enumerate(code.dictionary.to_pylist()):
                own = of == k
                at = np.flatnonzero(own[words.doc])
                _, first, n = np.unique(words.hash[at], return_index=True, return_counts=True)
                add(lang, _strings(raw, words.start[at[first]], words.end[at[first]]), n)
                add(lang, pa.array([_CLASS + str(c) for c in range(8)]), each[own].sum(axis=0))
            if rows > TASK_WORDS:
                table = summed()
                if table.num_rows > TASK_WORDS // 2:
                    yield from sent(table)
                else:
                    got += [pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], names)]
                    rows = table.num_rows
    if got:
        yield from sent(summed())


def references(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """ref_lang, classes, words, counts, total: one row per language, from one reading of all documents."""
    rows = docs.select(_lang().alias("ref_lang"), F.col("text").cast("string").alias("text"))
    # the word counts are read twice below; they are a few rows a word of the vocabulary
    counts = cut(rows.mapInArrow(_counts, "ref_lang string, word string, n bigint").groupBy("ref_lang", "word").agg(F.sum("n").alias("n")))
    is_class = F.col("word").startswith(_CLASS)
    nth = lambda k: F.sum(F.when(F.col("word") == _CLASS + str(k), F.col("n")).otherwise(0))
    both = counts.groupBy("ref_lang").agg(F.array(*(nth(k) for k in range(8))).alias("classes"), F.sum(F.when(is_class, 0).otherwise(F.col("n"))).alias("total"))
    w = Window.partitionBy("ref_lang").orderBy(F.desc("n"), "word")
    best = counts.where(~is_class).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= common).groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    best = best.select("ref_lang", F.col("top.word").alias("words"), F.col("top.n").alias("counts"))
    return both.join(best, "ref_lang", "left")


def judged(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, lang, char_distance, word_distance; null where the document isn't judged."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _lang().alias("ref_lang"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # one row a language: counted, and sent around if they are few, since a join by shuffle would gather each language's texts
    both = rows.join(sized(cut(references(docs, common)), MAX_SENT), "ref_lang", "left").select("doc_id", "lang", "text", "ref_lang", "classes", "words", "counts", "total")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                words = Words(part.column(2))
                size = np.diff(words.first)
                classes = class_counts(part.column(2))
                out = np.full((2, n), np.nan)
                code = part.column(3).dictionary_encode()
                at = code.indices.to_numpy(zero_copy_only=False)
                for lang in range(len(code.dictionary)):
                    own = np.flatnonzero(at == lang)
                    i = int(own[0])
                    top, counts, total = part.column(5)[i].as_py(), part.column(6)[i].as_py(), part.column(7)[i].as_py()
                    if not top:
                        continue
                    ref = Words(pa.array(top)).hash
                    order = np.argsort(ref)
                    k = np.minimum(np.searchsorted(ref[order], words.hash), len(ref) - 1)
                    column = np.where(ref[order][k] == words.hash, k, len(ref))
                    hist = np.bincount(words.doc * (len(ref) + 1) + column, minlength=n * (len(ref) + 1)).reshape(n, -1)[own]
                    base = np.append(np.array(counts)[order], total - sum(counts))
                    out[0, own] = distance(classes[own].astype(float), np.array(part.column(4)[i].as_py(), float))
                    out[1, own] = distance(hist.astype(float), base.astype(float))
                out[:, (classes.sum(axis=1) < MIN_CHARS) | (size < MIN_WORDS)] = np.nan
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, mask=np.isnan(x)) for x in out)], ["doc_id", "lang", "char_distance", "word_distance"])

    return both.mapInArrow(run, "doc_id bigint, lang string, char_distance double, word_distance double")


def kept(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, common: int = COMMON) -> DataFrame:
    """doc_id, lang and distances, to six places, of the documents that the rules keep."""
    ok = F.col("char_distance").isNull() | ((F.col("char_distance") <= char_limit) & (F.col("word_distance") <= word_limit))
    return judged(docs, common).where(ok).select("doc_id", "lang", *(F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")))
