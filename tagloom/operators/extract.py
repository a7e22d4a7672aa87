"""Files to comments and blocks.

Both are row-local: the format of a file follows from its name by built-in expressions,
files of unknown formats and files without anything like a tag never reach Python, and
no shuffle is involved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexers import EXTENSIONS, Lines, comments
from ..functions.tags import BlockError, blocks
from .schemas import BLOCKS, COMMENTS

#: Files, and characters of them, that are in Python at a time, whatever an Arrow batch holds; a longer file is alone.
SLICE_ROWS, SLICE_CHARS = 2_000, 1_000_000


def format_of(path: Column, remap: dict[str, str] | None = None) -> Column:
    """The format of a path: the shortest suffix after a dot that is known, at last the whole name; null if none is.

    ``remap`` maps suffixes to known ones and goes before the built-in table.
    """
    remap = remap or {}
    for k, v in remap.items():
        if v not in EXTENSIONS:
            raise ValueError(f"Unsupported extension mapping: {k}={v}")
    known = {**EXTENSIONS, **{k: EXTENSIONS[v] for k, v in remap.items()}}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(name, "\\.")
    # suffixes from the shortest to the longest, then the name
    tails = F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hits = F.filter(F.transform(tails, lambda t: F.try_element_at(table, t)), lambda f: f.isNotNull())
    # nearly always the last part decides, and the others aren't made
    return F.coalesce(F.try_element_at(table, F.substring_index(name, ".", -1)), F.get(hits, F.lit(0)))


def _with_format(files: DataFrame, remap: dict[str, str] | None) -> DataFrame:
    return files.where("path is not null and content is not null").withColumn("format", format_of(F.col("path"), remap)).where("format is not null")


def sliced(batch: pa.RecordBatch, text: str = "content") -> Iterator[list[list]]:
    """The columns of a batch as lists, a bounded part of its rows at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = chars = 0
    for at, size in enumerate(sizes):
        if at > begin and (at - begin >= SLICE_ROWS or chars + size > SLICE_CHARS):
            yield [c.to_pylist() for c in batch.slice(begin, at - begin).columns]
            begin, chars = at, 0
        chars += size
    if begin < len(sizes):
        yield [c.to_pylist() for c in batch.slice(begin).columns]


def extract_comments(files: DataFrame, remap: dict[str, str] | None = None) -> DataFrame:
    """All comments of all files of known formats."""

    def run(batches):
        for batch in batches:
            for columns in sliced(batch):
                rows = []
                for path, content, fmt in zip(*columns):
                    src = content.encode()
                    where = Lines(src)
                    for n, (a, b, text) in enumerate(comments(src, fmt)):
                        rows.append((path, n, _position(where.position(a)), _position(where.position(b)), a, b, text.decode("utf-8", "replace")))
                yield _batch(rows, COMMENTS_ARROW)

    return _with_format(files.select("path", "content"), remap).mapInArrow(run, COMMENTS)


def spread(files: DataFrame) -> DataFrame:
    """``files`` over as many tasks as there are cores, where they are stored in fewer files; more files are read as they are."""
    stored, cores = len(files.inputFiles()), files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if 0 < stored < cores else files


def tagged(files: DataFrame, remap: dict[str, str] | None = None, having: list[str] | None = None) -> DataFrame:
    """path, content and format of the files that may have blocks; with ``having``, of those with any of these words."""
    found = _with_format(files.select("path", "content"), remap).where(F.col("content").rlike(r"<\s*/?\s*block"))
    if having is None:
        return found
    some = F.lit(False)
    for word in having:
        some = some | F.col("content").contains(word)
    return found.where(some)


def extract_blocks(files: DataFrame, remap: dict[str, str] | None = None, having: list[str] | None = None) -> DataFrame:
    """All blocks of all files, numbered by their start in the file; a file whose tags don't pair has one row with an error.

    With ``having``, files without any of these words are passed over before they are parsed.
    """

    def run(batches):
        for batch in batches:
            for columns in sliced(batch):
                rows = []
                for path, content, fmt in zip(*columns):
                    src = content.encode()
                    try:
                        found = blocks(src, fmt)
                    except BlockError as e:
                        rows.append((path, None, None, None, None, None, None, None, None, None, f'Failed to parse file "{path}": {e}'))
                        continue
                    for n, b in enumerate(found):
                        text = src[b.content_byte_start : b.content_byte_end].decode("utf-8", "replace")
                        rows.append((path, n, b.attrs, b.tag_start, b.tag_end, text, b.content_byte_start, b.content_byte_end, b.content_start, b.content_end, None))
                yield _block_batch(rows)

    return tagged(files, remap, having).mapInArrow(run, BLOCKS)


def positions(places: Sequence[tuple[int, int] | None]) -> pa.StructArray:
    """An Arrow column of positions."""
    lines, characters = ([None if p is None else p[k] for p in places] for k in (0, 1))
    return pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(characters, pa.int64())], fields=list(_POSITION), mask=pa.array([p is None for p in places], pa.bool_()))


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(BLOCKS_ARROW)
    keys, values, ends = [], [], [0]
    for attrs in columns[2]:
        if attrs:
            keys += attrs
            values += attrs.values()
        ends.append(len(keys))
    # a null in place of a start makes the map null
    starts = [None if a is None else k for a, k in zip(columns[2], ends)] + ends[-1:]
    attrs = pa.MapArray.from_arrays(pa.array(starts, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
    made = [attrs if f.name == "attrs" else positions(c) if f.type == _POSITION else pa.array(c, f.type) for c, f in zip(columns, BLOCKS_ARROW)]
    return pa.RecordBatch.from_arrays(made, schema=BLOCKS_ARROW)


def _position(p: tuple[int, int]) -> dict[str, int]:
    return {"line": p[0], "character": p[1]}


_POSITION = pa.struct([("line", pa.int64()), ("character", pa.int64())])
COMMENTS_ARROW = pa.schema([("path", pa.string()), ("seq", pa.int32()), ("start", _POSITION), ("end", _POSITION), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("text", pa.string())])
BLOCKS_ARROW = pa.schema(
    [("path", pa.string()), ("ordinal", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())), ("tag_start", _POSITION), ("tag_end", _POSITION), ("content", pa.string())]
    + [("content_byte_start", pa.int64()), ("content_byte_end", pa.int64()), ("content_start", _POSITION), ("content_end", _POSITION), ("error", pa.string())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
