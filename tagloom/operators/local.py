"""The checks that a block decides alone, in one pass over its row.

Order, uniqueness, patterns and counts of a block's lines need nothing but the block, so a
batch of blocks goes to Python once, in Arrow, for all of these checks together, and comes
back as violations; there is no shuffle, and a row's lines never become rows. Patterns are
matched over all lines of a batch at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Linear, linear
from ..functions.tags import BlockError
from ..functions.tags import blocks as parsed
from ..functions.text import PY_SPACES
from .extract import positions, sliced, tagged
from .schemas import UNNAMED, VIOLATIONS

LOCAL = ("keep-sorted", "keep-unique", "line-pattern", "line-count")
SEVERITIES = {"error": 1, "warning": 2, "info": 3, "hint": 4}
#: Index of a line after the tag's, its value, and the byte columns that the value takes.
Line = tuple[int, str, int, int]
#: Why a run ends, or the violation: message, data, and the position of a line or None for the tag's.
Outcome = tuple[str | None, str, dict | None, Line | None]
_NUMBER = re.compile(r"[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)", re.I | re.A)
_POSITION = pa.struct([("line", pa.int64()), ("character", pa.int64())])
_ARROW = pa.schema([("path", pa.string()), ("start", _POSITION), ("end", _POSITION), ("code", pa.string()), ("message", pa.string()), ("severity", pa.int8()), ("data", pa.string()), ("error", pa.string())])


class Block:
    """What the checks see of a block."""

    __slots__ = ("path", "attrs", "tag_start", "tag_end", "content", "_rows", "_plain")

    def __init__(self, path: str, attrs: dict[str, str], tag_start: tuple[int, int], tag_end: tuple[int, int], content: str):
        self.path, self.attrs, self.tag_start, self.tag_end, self.content = path, attrs, tag_start, tag_end, content
        self._rows = self._plain = None

    @property
    def place(self) -> str:
        return f"{self.path}:{self.attrs.get('name', UNNAMED)}"

    @property
    def line(self) -> int:
        return self.tag_start[0]

    def at(self) -> str:
        return f" in {self.place} at line {self.line}"

    def defined(self) -> str:
        return f"Block {self.place} defined at line {self.line}"

    def rows(self) -> list[str]:
        """The lines without their breaks; a final break doesn't begin another line."""
        if self._rows is None:
            rows = self.content.split("\n")
            rows = rows[:-1] if rows[-1] == "" else rows
            self._rows = [r.removesuffix("\r") for r in rows] if "\r" in self.content else rows
        return self._rows

    def lines(self) -> list[Line]:
        """The lines that aren't blank, trimmed."""
        if self._plain is None:
            self._plain = []
            for i, row in enumerate(self.rows()):
                bare = row.strip(PY_SPACES)
                if bare:
                    lead = len(row) - len(row.lstrip(PY_SPACES))
                    first = lead if row.isascii() else len(row[:lead].encode())
                    self._plain.append((i, bare, first + 1, first + (len(bare) if bare.isascii() else len(bare.encode()))))
        return self._plain


def _matched(blocks: list[Block], option: str) -> Iterator[tuple[Block, list[Line] | None, str | None]]:
    """Each block with its values and why its pattern is none: what the pattern finds in the lines, or without a pattern the lines."""
    by: dict[str, list[int]] = {}
    for k, b in enumerate(blocks):
        if p := b.attrs.get(option):
            by.setdefault(p, []).append(k)
    found: dict[int, list[Line]] = {}
    bad: dict[int, str] = {}
    for p, own in by.items():
        compiled = linear(p)
        if isinstance(compiled, str):
            bad.update((k, compiled) for k in own if blocks[k].rows())
            found.update((k, []) for k in own)
            continue
        spans = iter(compiled.spans([r for k in own for r in blocks[k].rows()]))
        for k in own:
            found[k] = [(i, r[s[0] : s[1]] if r.isascii() else r.encode()[s[0] : s[1]].decode(), s[0] + 1, s[1]) for i, r in enumerate(blocks[k].rows()) if (s := next(spans)) is not None]
    for k, b in enumerate(blocks):
        yield b, found[k] if k in found else b.lines(), bad.get(k)


def _number(v: str) -> tuple | None:
    """A sort key in the total order of doubles; None for what isn't a number."""
    if not _NUMBER.fullmatch(v):
        return None
    x, minus = float(v), v.startswith("-")
    return (-1 if minus else 1, 0.0, 1) if x != x else (0, x, 0 if x == 0 and minus else 1)


def keep_sorted(blocks: list[Block]) -> Iterator[tuple[Block, Outcome]]:
    for b, lines, bad in _matched(blocks, "keep-sorted-pattern"):
        option = b.attrs["keep-sorted"]
        order = option.lower() if option.strip(PY_SPACES) else "asc"
        raw = b.attrs.get("keep-sorted-format", "").strip(PY_SPACES)
        fatal = None
        if order not in ("asc", "desc"):
            fatal = f'keep-sorted expected values are "asc" or "desc", got "{option}"{b.at()}'
        elif raw.lower() not in ("", "lexicographic", "numeric"):
            fatal = f'keep-sorted-format has an unsupported value "{raw}"{b.at()}'
        elif bad is not None:
            fatal = f"Invalid keep-sorted-pattern expression in block {b.place} defined at line {b.line}: {bad}"
        if fatal:
            yield b, (fatal, "", None, None)
            continue
        key = _number if raw.lower() == "numeric" else lambda v: v
        for before, at in zip(lines, lines[1:]):
            x, y = key(before[1]), key(at[1])
            if x is None or y is None:
                yield b, (f'in block {b.place} defined at line {b.line}: "{before[1] if x is None else at[1]}" is not a valid number', "", None, None)
                break
            if x > y if order == "asc" else x < y:
                yield b, (None, f"{b.defined()} has an out-of-order line {b.line + at[0]} ({order})", {"order_by": order}, at)
                break


def keep_unique(blocks: list[Block]) -> Iterator[tuple[Block, Outcome]]:
    for b, lines, bad in _matched(blocks, "keep-unique"):
        if bad is not None:
            yield b, (f"Invalid keep-unique regex pattern for block {b.place} defined at line {b.line}: {bad}", "", None, None)
            continue
        seen = set()
        for line in lines:
            if line[1] in seen:
                yield b, (None, f"{b.defined()} has a duplicated line {b.line + line[0]}", None, line)
                break
            seen.add(line[1])


def line_pattern(blocks: list[Block]) -> Iterator[tuple[Block, Outcome]]:
    by: dict[str, list[Block]] = {}
    for b in blocks:
        by.setdefault(b.attrs["line-pattern"], []).append(b)
    for p, own in by.items():
        compiled: Linear | str = linear(p)
        if isinstance(compiled, str):
            yield from ((b, (f'line-pattern expected a valid regular expression, got "{p}"{b.at()} (error: {compiled})', "", None, None)) for b in own)
            continue
        fits = iter(compiled.found_in([line[1] for b in own for line in b.lines()]))
        for b in own:
            wrong = [line for line in b.lines() if not next(fits)]
            if wrong:
                yield b, (None, f"{b.defined()} has a non-matching line {b.line + wrong[0][0]} (pattern: /{p}/)", {"pattern": p}, wrong[0])


_COMPARE: dict[str, Any] = {"<": int.__lt__, "<=": int.__le__, "==": int.__eq__, ">=": int.__ge__, ">": int.__gt__}


def line_count(blocks: list[Block]) -> Iterator[tuple[Block, Outcome]]:
    for b in blocks:
        raw = b.attrs["line-count"]
        bare = raw.strip(PY_SPACES)
        op = bare[:2] if bare[:2] in _COMPARE else bare[:1] if bare[:1] in _COMPARE else ""
        rest = bare[len(op) :].strip(PY_SPACES)
        why = "missing comparator" if not op else "missing number" if not rest else None if re.fullmatch(r"\+?[0-9]{1,18}", rest) else "invalid number"
        if why:
            yield b, (f'line-count expected a comparator like <N, <=N, ==N, >=N, >N; got "{raw}"{b.at()} (error: {why})', "", None, None)
            continue
        actual, expected = len(b.lines()), int(rest)
        if not _COMPARE[op](actual, expected):
            yield b, (None, f"{b.defined()} has {actual} lines, which does not satisfy {op}{expected}", {"actual": actual, "op": op, "expected": expected}, None)


_CHECKS = {"keep-sorted": keep_sorted, "keep-unique": keep_unique, "line-pattern": line_pattern, "line-count": line_count}


def _row(b: Block, code: str, outcome: Outcome) -> tuple:
    fatal, message, data, line = outcome
    severity = b.attrs.get("severity")
    level = 1 if severity is None else SEVERITIES.get(severity.lower())
    if fatal is None and level is None:
        # a severity that can't be read is an error, but only on a violation
        fatal = 'Failed to parse "severity" attribute'
    if fatal is not None:
        return b.path, None, None, code, None, None, None, fatal
    start, end = b.tag_start, b.tag_end
    if line is not None:
        # lines are counted from the start tag, whatever line the content begins on
        start, end = ((b.line + line[0], c) for c in line[2:])
    return b.path, start, end, code, message, level, None if data is None else json.dumps(data, ensure_ascii=False, separators=(",", ":")), None


def _violations(found: list[Block], names: list[str]) -> Iterator[pa.RecordBatch]:
    rows = [_row(b, n, out) for n in names for b, out in _CHECKS[n]([b for b in found if n in b.attrs])]
    if rows:
        columns = zip(zip(*rows), _ARROW)
        yield pa.RecordBatch.from_arrays([positions(c) if f.type == _POSITION else pa.array(c, f.type) for c, f in columns], schema=_ARROW)


def local_checks(blocks: DataFrame, names: list[str]) -> DataFrame:
    """Violations of the checks ``names`` of those above."""
    wanted = [n for n in LOCAL if n in names]

    def run(batches):
        for batch in batches:
            for columns in sliced(batch):
                yield from _violations([Block(p, dict(a), (s["line"], s["character"]), (e["line"], e["character"]), c) for p, a, s, e, c in zip(*columns)], wanted)

    asks: Column = F.lit(False)
    for n in wanted:
        asks = asks | F.map_contains_key("attrs", F.lit(n))
    return blocks.where(asks).select("path", "attrs", "tag_start", "tag_end", "content").mapInArrow(run, VIOLATIONS)


def local_file_checks(files: DataFrame, names: list[str], remap: dict[str, str] | None = None) -> DataFrame:
    """As ``local_checks`` over all blocks of ``files``, which don't leave Python in between; files whose tags don't pair are passed over."""
    wanted = [n for n in LOCAL if n in names]

    def run(batches):
        for batch in batches:
            for columns in sliced(batch):
                own = []
                for path, content, fmt in zip(*columns):
                    src = content.encode()
                    try:
                        found = parsed(src, fmt)
                    except BlockError:
                        continue
                    own += [Block(path, b.attrs, b.tag_start, b.tag_end, src[b.content_byte_start : b.content_byte_end].decode("utf-8", "replace")) for b in found]
                yield from _violations(own, wanted)

    return tagged(files, remap, wanted).mapInArrow(run, VIOLATIONS)
