"""Diffs to changes, and what they touch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.diffs import DiffError, changes
from ..functions.native import changed_ranges
from .extract import SLICE_ROWS, _batch


def diff_changes(diffs: DataFrame) -> DataFrame:
    """Changes of unified diffs, one diff a row of ``diffs`` (text); ``error`` says why one can't be used.

    Diffs are read in Python; the characters of lines that replace others are compared in the JVM.
    """

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0).to_pylist():
                try:
                    for path, found in changes(text or "", lambda old, new: (old, new)).items():
                        rows += [(path, n, *(pair or (None, None)), None) for n, pair in found]
                except DiffError as e:
                    rows.append((None, None, None, None, str(e)))
                if len(rows) >= SLICE_ROWS:
                    yield _batch(rows, _PAIRS)
                    rows = []
            if rows:
                yield _batch(rows, _PAIRS)

    pairs = diffs.select(F.col("text").cast("string")).mapInArrow(run, "path string, line bigint, old string, new string, error string")
    return pairs.select("path", "line", changed_ranges(diffs.sparkSession)(F.col("old"), F.col("new")).alias("ranges"), "error")


_PAIRS = pa.schema([("path", pa.string()), ("line", pa.int64()), ("old", pa.string()), ("new", pa.string()), ("error", pa.string())])


def _touches(change: Column, first: Column, last: Column, inclusive: bool) -> Column:
    """Whether a change touches a span of positions; ``inclusive`` says whether the span's last column belongs to it."""
    line = change["line"]
    low = F.when(line == first["line"], first["character"] - 1).otherwise(F.lit(0))
    high = F.when(line < last["line"], F.lit(2**62)).otherwise(last["character"] - 1)
    hit = F.exists(change["ranges"], lambda r: (r["e"] > low) & ((r["s"] <= high) if inclusive else (r["s"] < high)))
    return (line >= first["line"]) & (line <= last["line"]) & (change["ranges"].isNull() | hit)


def mark_modified(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """``blocks`` with is_start_tag_modified and is_content_modified.

    Changes are gathered per path, which bounds a row by one file's diff, and joined on
    it; the intervals are then compared inside the row, so no pair of block and change
    is ever a row of its own.
    """
    per = changes.where("path is not null").groupBy("path").agg(F.collect_list(F.struct("line", "ranges")).alias("changes__"))
    both = blocks.join(per, "path", "left")
    any_of = lambda a, b, inclusive: F.coalesce(F.exists("changes__", lambda c: _touches(c, F.col(a), F.col(b), inclusive)), F.lit(False))
    return both.withColumn("is_start_tag_modified", any_of("tag_start", "tag_end", True)).withColumn("is_content_modified", any_of("content_start", "content_end", False)).drop("changes__")
