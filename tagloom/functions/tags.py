"""Block tags in comments: tokens, attributes, pairing, spans."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import regex

from .lexers import Lines, comments

_NAME = r"[\p{Alphabetic}\p{N}_-]+"
_VALUE = rf"(?:\"[^\"]*\"|'[^']*'|{_NAME})"
_SPACE = r"[ \t\r\n]"
#: Possessive, since the grammar of attributes never reconsiders what it has read.
START = regex.compile(rf"<block((?:{_SPACE}+{_NAME}(?:{_SPACE}*={_SPACE}*{_VALUE})?)*+){_SPACE}*>")
END = regex.compile(rf"<{_SPACE}*/{_SPACE}*block{_SPACE}*>")
_ATTRIBUTE = regex.compile(rf"{_SPACE}+({_NAME})(?:{_SPACE}*={_SPACE}*({_VALUE}))?")
#: Characters of comments whose tags are kept for the next comment that reads the same.
OFTEN = 256


class BlockError(ValueError):
    """Tags of a file that don't pair up."""


@dataclass(frozen=True)
class Block:
    attrs: dict[str, str]
    tag_start: tuple[int, int]
    #: Position of the start tag's last byte.
    tag_end: tuple[int, int]
    content_byte_start: int
    content_byte_end: int
    content_start: tuple[int, int]
    content_end: tuple[int, int]


def attributes(text: str) -> dict[str, str]:
    """The attributes of a start tag; the last of repeated names counts, a name alone is empty."""
    return {m[1]: "" if m[2] is None else m[2][1:-1] if m[2][:1] in "\"'" else m[2] for m in _ATTRIBUTE.finditer(text)}


def tags(text: str) -> list[tuple[int, int, dict[str, str] | None]]:
    """(start, end, attributes or None for an end tag) of all tags, in characters."""
    out, at = [], text.find("<")
    while at >= 0:
        if m := START.match(text, at):
            out.append((at, m.end(), attributes(m[1])))
        elif m := END.match(text, at):
            out.append((at, m.end(), None))
        at = text.find("<", m.end() if m else at + 1)
    return out


@lru_cache(maxsize=4096)
def _often(text: str) -> list[tuple[int, int, dict[str, str] | None]]:
    return tags(text)


def blocks(src: bytes, fmt: str) -> list[Block]:
    """The blocks of a file, by position of their start tags; raises BlockError where tags don't pair."""
    where = Lines(src)
    opened: list[tuple[int, int, dict, tuple, tuple]] = []
    out = []
    for start, end, text in comments(src, fmt):
        if b"block" not in text:
            continue
        chars = text.decode("utf-8")
        for a, b, attrs in _often(chars) if len(chars) <= OFTEN else tags(chars):
            first = start + len(chars[:a].encode())
            if attrs is not None:
                last = start + len(chars[:b].encode()) - 1
                opened.append((start, end, dict(attrs), where.position(first), where.position(last)))
                continue
            if not opened:
                raise BlockError(f"Unexpected closed block at line {where.position(start)[0]}, position {first}")
            own, begin, attrs, tag_start, tag_end = opened.pop()
            span = (begin, start) if own != start else (0, 0)
            out.append(Block(attrs, tag_start, tag_end, *span, where.position(begin), where.position(start)))
    if opened:
        raise BlockError(f"Block at line {where.position(opened[-1][0])[0]} is not closed")
    return sorted(out, key=lambda b: b.tag_start)


def may_have_tags(src: bytes) -> bool:
    """A cheap test that every file with a tag, paired or not, passes."""
    return re.search(rb"<\s*/?\s*block", src) is not None
