"""Disjoint spans of a text, in logarithmic time a span."""

from __future__ import annotations

from bisect import bisect_left


class Disjoint:
    """Accepts spans that overlap none accepted before."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, a)
        if (i and self.ends[i - 1] > a) or (i < len(self.starts) and self.starts[i] < b):
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores as make it differ from all column names in ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
