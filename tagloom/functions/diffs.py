"""Unified diffs: changed lines of the new files, with changed character ranges."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import numpy as np

PAIR_LIMIT, BYTE_LIMIT = 10_000, 65_536
#: Characters of one line times characters of the other: from the first, shortest paths to all places are computed at once; beyond the second, steps of all diagonals.
TABLE, WIDE = 400, 4_000_000
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")

Ranges = list[tuple[int, int]]


class DiffError(ValueError):
    """A diff that can't be read, or that leaves the repository."""


def _snake(old: str, new: str) -> tuple[int, int] | None:
    """A point on a shortest edit path of two lines with different ends: where the searches from both ends meet."""
    n, m = len(old), len(new)
    delta = n - m
    odd = delta % 2 == 1
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(d, -d - 1, -2):
            x = ahead.get(k + 1, 0) if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            begin = (x, y)
            while x < n and 0 <= y < m and old[x] == new[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and abs(k - delta) <= d - 1 and x + back[delta - k] >= n:
                return begin
        for k in range(d, -d - 1, -2):
            x = back.get(k + 1, 0) if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            while x < n and 0 <= y < m and old[n - 1 - x] == new[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and abs(k - delta) <= d and x + ahead[delta - k] >= n:
                return n - x, m - y
    return None


def _characters(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _along(x: np.ndarray, y: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
    """Moves points over all the characters that follow them in both lines."""
    n, m = len(old), len(new)
    at = np.flatnonzero((x < n) & (y >= 0) & (y < m))
    while len(at):
        at = at[old[x[at]] == new[y[at]]]
        x[at] += 1
        y[at] += 1
        at = at[(x[at] < n) & (y[at] < m)]


def _wide_snake(old: np.ndarray, new: np.ndarray) -> tuple[int, int] | None:
    """As ``_snake``, a step of all diagonals at a time."""
    n, m = len(old), len(new)
    delta = n - m
    odd = delta % 2 == 1
    top = (n + m + 1) // 2 + 2
    zero = top + abs(delta)
    ahead, back = (np.zeros(2 * zero + 1, dtype=np.int64) for _ in range(2))
    dlo, wen = old[::-1], new[::-1]

    def step(reached: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.arange(d, -d - 1, -2)
        left, right = reached[zero + k - 1], reached[zero + k + 1]
        down = left < right
        down[0] = d == 0
        down[-1] = True
        x = np.where(down, right, left + 1)
        return k, x, x - k

    for d in range((n + m + 1) // 2 + 1):
        k, x, y = step(ahead, d)
        begin = x.copy()
        _along(x, y, old, new)
        ahead[zero + k] = x
        if odd:
            met = np.flatnonzero((np.abs(k - delta) <= d - 1) & (x + back[zero + delta - k] >= n))
            if len(met):
                i = met[0]
                return int(begin[i]), int(begin[i] - k[i])
        k, x, y = step(back, d)
        _along(x, y, dlo, wen)
        back[zero + k] = x
        if not odd:
            met = np.flatnonzero((np.abs(k - delta) <= d) & (x + ahead[zero + delta - k] >= n))
            if len(met):
                i = met[0]
                return int(n - x[i]), int(m - (x[i] - k[i]))
    return None


def _rows(old: str, new: str):
    """For each prefix of ``new`` a number whose bit i is unset where a longest common subsequence with ``old`` grows at character i; a step updates all bits at once."""
    where: dict[str, int] = {}
    for i, c in enumerate(old):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(old)) - 1
    yield row
    for c in new:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
        yield row


def _distances(old: str, new: str) -> np.ndarray:
    """Edits between all prefixes of ``new`` (rows) and of ``old`` (columns)."""
    n, m = len(old), len(new)
    wide = (n + 7) // 8
    packed = np.frombuffer(b"".join(row.to_bytes(wide, "little") for row in _rows(old, new)), dtype=np.uint8).reshape(m + 1, wide)
    out = np.zeros((m + 1, n + 1), dtype=np.int32)
    # a character of old costs one edit, unless it is in common, which saves one of new's as well
    np.cumsum(np.unpackbits(packed, axis=1, count=n, bitorder="little").astype(np.int8) * np.int8(2) - np.int8(1), axis=1, dtype=np.int32, out=out[:, 1:])
    out += np.arange(m + 1, dtype=np.int32)[:, None]
    return out


def _table_snake(old: str, new: str) -> tuple[int, int] | None:
    """As ``_snake``, from the edits between all prefixes and between all suffixes."""
    n, m = len(old), len(new)
    delta = n - m
    ahead, back = _distances(old, new), _distances(old[::-1], new[::-1])
    edits = int(ahead[m, n])
    diagonal = np.arange(n + 1)[None, :] - np.arange(m + 1)[:, None] + m
    k = np.arange(n, -m - 1, -1)
    none = -2 * (n + m)

    def reach(distance: np.ndarray, d: int) -> np.ndarray:
        """The farthest column of each diagonal, from n to -m, within d edits."""
        cells = np.bincount(diagonal[distance <= d], minlength=n + m + 1)[::-1]
        x = np.maximum(k, 0) + cells - 1
        x[(cells == 0) | (np.abs(k) > d)] = none
        return x

    d = (edits + 1) // 2
    step = (np.abs(k) <= d) & ((k - d) % 2 == 0)
    if edits % 2:
        x, other = reach(ahead, d), reach(back, d - 1)
        before = np.concatenate([[none], reach(ahead, d - 1), [none]])
        met = np.flatnonzero(step & (np.abs(k - delta) <= d - 1) & (x + other[::-1] >= n))
        if not len(met):
            return None
        i = int(met[0])
        # diagonal k + 1 is one place ahead, k - 1 one behind
        begin = int(max(before[i], before[i + 2] + 1))
        return begin, begin - int(k[i])
    x, other = reach(back, d), reach(ahead, d)
    met = np.flatnonzero(step & (np.abs(k - delta) <= d) & (x + other[::-1] >= n))
    if not len(met):
        return None
    i = int(met[0])
    return n - int(x[i]), m - int(x[i] - k[i])


def _middle(old: str, new: str) -> tuple[int, int] | None:
    size = len(old) * len(new)
    if size < TABLE:
        return _snake(old, new)
    return _table_snake(old, new) if size <= WIDE else _wide_snake(_characters(old), _characters(new))


def opcodes(old: str, new: str) -> list[tuple[str, int, int, int, int]]:
    """A minimal edit script of two lines, by Myers' algorithm in linear space; what is deleted and inserted in one place is a replacement."""
    script: list[list[int]] = []  # runs of changes, as spans of old and new

    def changed(a: int, b: int, c: int, d: int) -> None:
        if script and script[-1][1] == a and script[-1][3] == c:
            script[-1][1], script[-1][3] = b, d
        else:
            script.append([a, b, c, d])

    todo = [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
        if a == b or c == d:
            if a < b or c < d:
                changed(a, b, c, d)
        elif (at := _middle(old[a:b], new[c:d])) is None or at in ((0, 0), (b - a, d - c)):
            changed(a, b, c, d)
        else:
            todo += [(a + at[0], b, c + at[1], d), (a, a + at[0], c, c + at[1])]
    return [("replace" if a < b and c < d else "delete" if a < b else "insert", a, b, c, d) for a, b, c, d in script]


def in_common(old: str, new: str) -> int:
    """Length of a longest common subsequence."""
    for row in _rows(old, new):
        pass
    return len(old) - row.bit_count()


def ratio(old: str, new: str) -> float:
    """Twice the characters in common over all characters."""
    if not old and not new:
        return 1.0
    return 2 * in_common(old, new) / (len(old) + len(new))


def changed_ranges(old: str, new: str) -> Ranges:
    """Half-open ranges of characters of ``new`` that differ; what is only deleted marks one character."""
    last = max(len(new.encode()) - 1, 0)
    found: Ranges = []
    for kind, _, _, c, d in opcodes(old, new):
        found.append((min(last, c), min(last, c) + 1) if kind == "delete" else (c, d))
    return merged(found)


def merged(ranges: Ranges) -> Ranges:
    """Sorted ranges with those that touch or overlap joined."""
    out: Ranges = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def align(removed: list[str], added: list[str]) -> list[int | None]:
    """For each added line the removed line that it replaces, most similar pairs first, never crossing."""
    if not removed:
        return [None] * len(added)
    size = sum(len(x.encode()) for x in removed + added)
    if len(removed) * len(added) > PAIR_LIMIT or size > BYTE_LIMIT:
        return [i if i < len(removed) else None for i in range(len(added))]
    if len(removed) == len(added) == 1:
        return [0]
    table = [[ratio(r, a) for a in added] for r in removed]
    out: list[int | None] = [None] * len(added)
    todo = [(0, len(removed), 0, len(added))]
    while todo:
        r0, r1, a0, a1 = todo.pop()
        if r0 < r1 and a0 < a1:
            r, a = max(((r, a) for r in range(r0, r1) for a in range(a0, a1)), key=lambda p: (table[p[0]][p[1]], -p[0], -p[1]))
            out[a] = r
            todo += [(r0, r, a0, a), (r + 1, r1, a + 1, a1)]
    return out


def _group(removed: list[str], added: list[tuple[int, str]], anchor: int, compare: Callable[[str, str], Any]) -> list[tuple[int, Any]]:
    if not added:
        return [(anchor, None)] if removed else []
    of = align(removed, [t for _, t in added])
    return [(n, None if r is None else compare(removed[r], t)) for (n, t), r in zip(added, of)]


def _path(raw: str) -> str:
    path = raw.split("\t")[0].strip()
    while path.startswith("b/"):
        path = path[2:]
    return path


def changes(text: str, compare: Callable[[str, str], Any] = changed_ranges) -> dict[str, list[tuple[int, Any]]]:
    """For each file that exists after the diff its changes: (line, ranges, or None for the whole line).

    ``compare`` makes the ranges of a line from what it was and is.

    A file whose one hunk has nothing on the new side is gone or empty; either way it has no changes.
    """
    out: dict[str, list[tuple[int, Ranges | None]]] = {}
    lines = text.split("\n")
    at, found, source = 0, None, ""
    hunks: dict[str, list[tuple[int, int]]] = {}
    while at < len(lines):
        line = lines[at]
        at += 1
        if line.startswith("--- "):
            source = line[4:].split("\t")[0].strip()
        elif line.startswith("+++ "):
            raw = line[4:].split("\t")[0].strip()
            found = None
            if raw != "/dev/null":
                path = _path(line[4:])
                if path.startswith("/") or ".." in path.split("/"):
                    raise DiffError(f'diff target path "{path}" escapes the repository root folder')
                found = out.setdefault(path, [])
                own = hunks.setdefault(path, [])
        elif (m := _HUNK.match(line)) and (found is not None or source):
            left, right = (1 if m[k] is None else int(m[k]) for k in (2, 4))
            target = int(m[3])
            if found is not None:
                own.append((target, right))
            last = target if right == 0 else max(target - 1, 0)
            removed: list[str] = []
            added: list[tuple[int, str]] = []
            got: list[tuple[int, Any]] = []
            while (left > 0 or right > 0 or lines[at : at + 1] and lines[at].startswith("\\")) and at < len(lines):
                body, at = lines[at], at + 1
                kind, value = body[:1], body[1:].removesuffix("\r") if body[:1] != " " else body[1:]
                if kind == "+":
                    added.append((target, value))
                    last, target, right = target, target + 1, right - 1
                elif kind == "-":
                    removed.append(value)
                    left -= 1
                elif kind == "\\":
                    continue
                else:
                    got += _group(removed, added, last + 1, compare)
                    removed, added = [], []
                    last, target, left, right = target, target + 1, left - 1, right - 1
            got += _group(removed, added, last + 1, compare)
            if found is not None:
                for n, ranges in got:
                    if found and found[-1][0] > n:
                        raise DiffError(f"diff hunks are out of order: a change at line {n} follows a change at line {found[-1][0]}")
                    found.append((n, ranges))
    return {path: got for path, got in out.items() if hunks[path] != [(0, 0)]}
