"""Comment recognition for 35 file formats, driven by a table of token patterns.

A format is a list of token patterns, tried at every position from left to right: what
matches a *skip* pattern (strings, raw text, regular expressions) can't hold a comment,
what matches a *comment* pattern is one. Everything works on UTF-8 bytes, so offsets and
columns count bytes. A comment's text has its markers blanked and its length unchanged,
hence offsets in it are offsets in the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

Blank = Callable[[bytes], bytes | None]


def blank(data: bytes) -> bytes:
    """Spaces for all bytes but line breaks."""
    return re.sub(rb"[^\r\n]", b" ", data)


def prefix(*markers: bytes) -> Blank:
    """Blanks the first marker that the comment starts with; other comments stay as they are."""

    def run(c: bytes) -> bytes:
        for m in markers:
            if c.startswith(m):
                return b" " * len(m) + c[len(m) :]
        return c

    return run


def starred(c: bytes) -> bytes:
    """A block comment without its delimiters and without one leading star per line."""
    body = re.sub(rb"(?m)^([ \t\r\f\v]*)\*", rb"\1 ", c[2:-2])
    return b"  " + body + b"  "


def angled(c: bytes) -> bytes:
    return b"    " + c[4:-3] + b"   "


def bracketed(c: bytes) -> bytes:
    """The content of a long bracket; its opening is whatever ends with the second bracket."""
    m = re.match(rb"[#-]+\[(=*)\[", c)
    n = 2 + len(m.group(1))
    return b" " * m.end() + c[m.end() : -n] + b" " * n


def begin_end(c: bytes) -> bytes:
    at = c.rfind(b"\n") + 1
    return b" " * 6 + c[6:at] + b" " * 4 + c[at + 4 :]


def shebangless(c: bytes) -> bytes | None:
    return None if c.startswith(b"#!") else b" " + c[1:]


DQ, SQ = rb'"(?:\\.|[^"\\\n])*"', rb"'(?:\\.|[^'\\\n])*'"
DQ_LINES, SQ_LINES = rb'"(?:\\.|[^"\\])*"', rb"'(?:\\.|[^'\\])*'"
DQ3, SQ3 = rb'"""(?:\\.|(?!""").)*"""', rb"'''(?:\\.|(?!''').)*'''"
RAW3 = rb'"""(?:(?!""").)*"{3,}'
CHAR = rb"'(?:\\[^\n']{1,10}|\\'|[^'\\\n]{1,4})'"
TICK = rb"`[^`]*`"
TEMPLATE = rb"`(?:\\.|\$\{(?:[^{}`]|`(?:\\.|[^`\\])*`|\{[^{}]*\})*\}|[^`\\])*`"
SLASHES, BLOCK = rb"//[^\n]*", rb"/\*.*?\*/"
SLASHES_JOINED = rb"//(?:\\\r?\n|[^\n])*"
HASH = rb"#[^\n]*"
REGEX = rb"(?<=[=(,:;!&|?{}\[+\n])[ \t]*/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*|\breturn[ \t]+/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/"
HEREDOC = rb"<<[-~]?[ \t]*(?P<q%d>[\"'`]?)(?P<h%d>[A-Za-z_]\w*)(?P=q%d)[^\n]*\n(?:.*?\n)??[ \t]*(?P=h%d)(?=[\s;,)]|$)"


def heredoc(n: int) -> bytes:
    return HEREDOC.replace(b"%d", str(n).encode())


@dataclass(frozen=True)
class Format:
    comments: tuple[tuple[bytes, Blank], ...]
    skips: tuple[bytes, ...] = ()
    nested: bool = False
    own: Callable[[bytes], list] | None = field(default=None, compare=False)


def _c(*skips: bytes, line: Blank = prefix(b"//"), nested: bool = False, lines: bytes = SLASHES) -> Format:
    return Format(((lines, line), (BLOCK, starred)), skips, nested)


DOC = prefix(b"///", b"//")
HASHED = prefix(b"#")


def _hash(*skips: bytes, mark: bytes = HASH, proc: Blank = HASHED) -> Format:
    return Format(((mark, proc),), skips)


@lru_cache(maxsize=None)
def _token(comments: tuple[bytes, ...], skips: tuple[bytes, ...]) -> re.Pattern[bytes]:
    """One pattern of all tokens of a format, made once in a process."""
    marks = [b"(?P<c%d>%s)" % (i, p) for i, p in enumerate(comments)]
    return re.compile(b"|".join(marks + [b"(?P<s%d>%s)" % (i, p) for i, p in enumerate(skips)]), re.S | re.M)


def scan(fmt: Format, src: bytes) -> list[tuple[int, int, bytes]]:
    """(start, end, text) of all comments of a format without a lexer of its own, in order."""
    token = _token(tuple(p for p, _ in fmt.comments), fmt.skips)
    out, at = [], 0
    while m := token.search(src, at):
        kind, start, end = m.lastgroup, m.start(), m.end()
        for i in range(len(fmt.comments)):
            if m.group(f"c{i}") is not None:
                kind = f"c{i}"
        if kind[0] == "c":
            if fmt.nested and src.startswith(b"/*", start):
                end = _nested_end(src, start)
                if end < 0:
                    at = start + 2
                    continue
            text = fmt.comments[int(kind[1:])][1](src[start:end])
            if text is not None:
                out.append((start, end, text))
        at = max(end, start + 1)
    return out


def _nested_end(src: bytes, at: int) -> int:
    depth = 0
    for m in re.compile(rb"/\*|\*/").finditer(src, at):
        depth += 1 if m.group() == b"/*" else -1
        if not depth:
            return m.end()
    return -1


def _html(src: bytes) -> list[tuple[int, int, bytes]]:
    token = re.compile(rb"(?P<c><!--.*?-->)|<(?P<t>script|style)\b[^>]*>.*?</(?P=t)\s*>", re.S | re.I)
    return [(m.start(), m.end(), angled(m.group())) for m in token.finditer(src) if m.group("c")]


def _xml(src: bytes) -> list[tuple[int, int, bytes]]:
    token = re.compile(rb"(?P<c><!--.*?-->)|<!\[CDATA\[.*?\]\]>", re.S)
    return [(m.start(), m.end(), angled(m.group())) for m in token.finditer(src) if m.group("c")]


PHP_CODE = Format(((rb"//(?:(?!\?>)[^\n])*", prefix(b"//")), (rb"#(?!\[)(?:(?!\?>)[^\n])*", HASHED), (BLOCK, starred)), (DQ_LINES, SQ_LINES, TICK, rb"<<<[ \t]*(?P<q1>[\"']?)(?P<h1>[A-Za-z_]\w*)(?P=q1)\r?\n.*?^[ \t]*(?P=h1)\b", rb"(?P<out>\?>)"))


def _php(src: bytes) -> list[tuple[int, int, bytes]]:
    """Comments in code, and HTML comments of the template around it, which code may interrupt."""
    out, view, at = [], bytearray(blank(src)), 0
    while at < len(src):
        m = re.compile(rb"<\?(?:php\b|=)?", re.I).search(src, at)
        start = m.start() if m else len(src)
        view[at:start] = src[at:start]
        if not m:
            break
        end = _php_end(src, m.end())
        out += [(a + m.end(), b + m.end(), t) for a, b, t in scan(PHP_CODE, src[m.end() : end])]
        at = end + 2 if end < len(src) else len(src)
    if b"<!--" in src:
        out += _html(bytes(view))
    return sorted(out)


def _php_end(src: bytes, at: int) -> int:
    skip = re.compile(b"|".join([rb"(?P<end>\?>)", rb"//(?:(?!\?>)[^\n])*", rb"#(?!\[)(?:(?!\?>)[^\n])*", BLOCK, *PHP_CODE.skips[:4]]), re.S | re.M)
    for m in skip.finditer(src, at):
        if m.group("end"):
            return m.start()
    return len(src)


_FENCE = re.compile(rb" {0,3}(`{3,}|~{3,})([^\n]*)")
_REFERENCE = re.compile(rb"[ ]{0,3}(\[//\]:[ \t]*\n?[ \t]*\S+(?:[ \t]+|[ \t]*\n[ \t]*)(?:\((?:\\.|[^)\\])*\)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')[ \t]*(?:\n|\Z))", re.S)


def reference_text(c: bytes) -> bytes:
    """A link reference used as a comment, with everything but its title blanked."""
    start = re.compile(rb"[(\"']").search(c, 5).start()
    close = c.rfind({40: b")", 34: b'"', 39: b"'"}[c[start]])
    return b" " * (start + 1) + c[start + 1 : close] + b" " + c[close + 1 :]


def _markdown(src: bytes) -> list[tuple[int, int, bytes]]:
    out: list[tuple[int, int, bytes]] = []
    view = bytearray(src)
    at, fence, paragraph, html = 0, None, False, False
    inline: list[list[int]] = []
    while at < len(src):
        end = src.find(b"\n", at)
        end = len(src) if end < 0 else end + 1
        line = src[at:end]
        bare = line.strip()
        if fence:
            close = re.fullmatch(rb" {0,3}(`{3,}|~{3,})\s*", line.rstrip(b"\r\n"))
            view[at:end] = blank(line)
            if close and close.group(1)[:1] == fence[:1] and len(close.group(1)) >= len(fence):
                fence = None
            paragraph = False
        elif html:
            html = b"-->" not in line
            paragraph = False
        elif not bare:
            paragraph = False
        elif (m := _FENCE.match(line)) and not (m.group(1)[:1] == b"`" and b"`" in m.group(2)):
            fence = m.group(1)
            view[at:end] = blank(line)
        elif not paragraph and (m := _REFERENCE.match(src, at)):
            out.append((m.start(1), m.end(1), reference_text(m.group(1))))
            view[m.start() : m.end()] = blank(src[m.start() : m.end()])
            end = m.end()
        elif not paragraph and re.match(rb" {4}|\t", line):
            view[at:end] = blank(line)
        elif re.match(rb" {0,3}<!--", line):
            html = b"-->" not in line.split(b"<!--", 1)[1]
            paragraph = False
        elif re.match(rb" {0,3}#{1,6}(\s|$)", line):
            inline.append([at, end])
            paragraph = False
        else:
            if paragraph and inline and inline[-1][1] == at:
                inline[-1][1] = end
            else:
                inline.append([at, end])
            paragraph = True
        at = end
    for a, b in inline:
        part = bytes(view[a:b])
        if b"`" in part:
            for m in re.compile(rb"(?<!`)(`+)(?!`)(?:.*?[^`])??\1(?!`)", re.S).finditer(part):
                view[a + m.start() : a + m.end()] = blank(m.group())
    out += [(m.start(), m.end(), angled(m.group())) for m in re.compile(rb"<!--.*?-->", re.S).finditer(bytes(view))]
    return sorted(out)


def _yaml(src: bytes) -> list[tuple[int, int, bytes]]:
    token = re.compile(rb"(?P<c>(?:(?<=\s)|\A)#[^\n]*)|(?:(?<=[\s:,\[{-])|\A)(?:\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*')|(?P<s>(?<=[:\-?\s])[ \t]*[|>][+\-0-9]*(?=[ \t]*(?:[ ]#[^\n]*)?(?:\r?\n|\Z)))", re.S)
    out, at = [], 0
    while m := token.search(src, at):
        at = max(m.end(), m.start() + 1)
        if m.group("c") is not None:
            out.append((m.start(), m.end(), HASHED(m.group())))
        elif m.group("s") is not None:
            begin = src.rfind(b"\n", 0, m.start()) + 1
            indent = len(src[begin:]) - len(src[begin:].lstrip(b" "))
            eol = src.find(b"\n", m.end())
            if eol < 0:
                continue
            if (h := re.match(rb"[ \t]+(#[^\n]*)", src[m.end() : eol])) is not None:
                out.append((m.end() + h.start(1), m.end() + h.end(1), HASHED(h.group(1))))
            at = eol + 1
            while at < len(src):
                nxt = src.find(b"\n", at)
                nxt = len(src) if nxt < 0 else nxt + 1
                line = src[at:nxt]
                if line.strip() and len(line) - len(line.lstrip(b" ")) <= indent:
                    break
                at = nxt
            at = max(0, at - 1)
    return out


def _dockerfile(src: bytes) -> list[tuple[int, int, bytes]]:
    """Lines that begin with a hash; a comment holds its line break."""
    return [(m.start(1), m.end(1), HASHED(m[1])) for m in re.compile(rb"^[ \t]*(#[^\n]*\n?)", re.M).finditer(src)]


RUST_LINE = rb"//(?:(?:/(?!/)|!)[^\n]*\n?|[^\n]*)"
JS = Format(((SLASHES, prefix(b"//")), (BLOCK, starred), (rb"<!--[^\n]*|^[ \t]*-->[^\n]*", prefix(b"<!--", b"-->"))), (DQ, SQ, TEMPLATE, REGEX))


def _js(src: bytes) -> list[tuple[int, int, bytes]]:
    out = []
    for a, b, t in scan(JS, src):
        raw = src[a:b]
        lead = len(raw) - len(raw.lstrip(b" \t"))
        out.append((a + lead, b, prefix(b"<!--", b"-->")(raw[lead:])) if raw.lstrip(b" \t").startswith(b"-->") else (a, b, t))
    return out


FORMATS: dict[str, Format] = {
    "bash": _hash(rb"\\.", rb"\$\{[^}\n]*\}", rb"\$#", heredoc(1), DQ_LINES, rb"'[^']*'", mark=rb"(?:(?<=[\s;&|()])|\A)#[^\n]*", proc=shebangless),
    "c": _c(DQ, CHAR, lines=SLASHES_JOINED),
    "c_sharp": _c(RAW3, rb'\$?@\$?"(?:""|[^"])*"', DQ, CHAR, line=DOC),
    "cmake": Format(((rb"#\[(?P<e1>=*)\[.*?\](?P=e1)\]", bracketed), (HASH, HASHED)), (DQ_LINES, rb"\[(?P<e2>=*)\[.*?\](?P=e2)\]")),
    "cpp": _c(rb'R"(?P<d>[^\s()\\]{0,16})\(.*?\)(?P=d)"', DQ, CHAR, lines=SLASHES_JOINED),
    "css": Format(((BLOCK, starred),), (DQ, SQ, rb"url\([^)\"'\n]*\)")),
    "dart": _c(rb"r'[^'\n]*'", rb'r"[^"\n]*"', DQ3, SQ3, DQ, SQ, line=DOC, nested=True),
    "dockerfile": Format((), own=_dockerfile),
    "elixir": _hash(DQ3, SQ3, rb"~[a-zA-Z]\"\"\".*?\"\"\"", rb"~[rswcRSWC](?:/(?:\\.|[^/\\])*/|\((?:\\.|[^)\\])*\)|\[[^\]]*\]|\{[^}]*\}|\|[^|]*\|)", DQ_LINES, SQ, rb"\?#"),
    "go": _c(TICK, DQ, CHAR),
    "graphql": _hash(DQ3, DQ),
    "groovy": _c(DQ3, SQ3, DQ, SQ, REGEX),
    "hcl": Format(((SLASHES, prefix(b"//")), (HASH, HASHED), (BLOCK, starred)), (heredoc(1), DQ)),
    "html": Format((), own=_html),
    "java": _c(DQ3, DQ, CHAR, line=DOC),
    "javascript": Format((), own=_js),
    "kotlin": _c(RAW3, DQ, CHAR, nested=True),
    "lua": Format(((rb"--\[(?P<e1>=*)\[.*?\](?P=e1)\]", bracketed), (rb"--[^\n]*", prefix(b"--"))), (DQ_LINES, SQ_LINES, rb"\[(?P<e2>=*)\[.*?\](?P=e2)\]")),
    "makefile": _hash(rb"\\.", rb"^\t[^\n#]*\S[^\n]*"),
    "markdown": Format((), own=_markdown),
    "nix": Format(((HASH, HASHED), (BLOCK, starred)), (rb"''(?:''[$'\\]|(?!'').)*''", DQ_LINES)),
    "php": Format((), own=_php),
    "proto": _c(DQ, SQ),
    "python": _hash(DQ3, SQ3, DQ, SQ),
    "ruby": Format(((rb"^=begin\b.*?^=end\b[^\n]*", begin_end), (HASH, HASHED)), (rb"\?#", heredoc(1), rb"%[qQwWiIr]?(?:\{[^{}]*\}|\([^()]*\)|\[[^\[\]]*\])", DQ_LINES, SQ_LINES, TICK, REGEX)),
    "rust": Format(((RUST_LINE, prefix(b"///", b"//!", b"//")), (BLOCK, starred)), (rb'\bb?r(?P<r>#*)".*?"(?P=r)', DQ_LINES, CHAR), True),
    "scala": _c(RAW3, DQ, CHAR, nested=True),
    "sql": Format(((rb"--[^\n]*", prefix(b"--")), (BLOCK, starred)), (rb"'(?:''|[^'])*'", rb'"(?:""|[^"])*"')),
    "starlark": _hash(DQ3, SQ3, DQ, SQ),
    "swift": _c(rb'(?P<r>#+)""".*?"""(?P=r)', rb'(?P<r2>#+)".*?"(?P=r2)', DQ3, DQ, line=DOC, nested=True),
    "toml": _hash(DQ3, rb"'''.*?'''", DQ, rb"'[^'\n]*'"),
    "typescript": Format((), own=_js),
    "tsx": Format((), own=_js),
    "xml": Format((), own=_xml),
    "yaml": Format((), own=_yaml),
}

#: Formats by the end of a file's name, or by the whole name.
EXTENSIONS: dict[str, str] = {
    ext: name
    for name, exts in {
        "bash": "bash sh",
        "c": "c",
        "c_sharp": "cs",
        "cmake": "CMakeLists.txt cmake",
        "cpp": "h cc cpp",
        "css": "css",
        "dart": "dart",
        "dockerfile": "Dockerfile dockerfile Containerfile containerfile",
        "elixir": "exs ex",
        "go": "go go.work go.sum go.mod",
        "graphql": "graphql gql",
        "groovy": "groovy gradle Jenkinsfile jenkinsfile",
        "hcl": "tf tfvars hcl",
        "html": "html htm",
        "java": "java",
        "javascript": "jsx js",
        "kotlin": "kts kt",
        "lua": "lua",
        "makefile": "makefile Makefile mk",
        "markdown": "md markdown",
        "nix": "nix",
        "php": "phtml php",
        "proto": "proto",
        "python": "pyi py",
        "ruby": "rb",
        "rust": "rs",
        "scala": "scala sbt",
        "sql": "sql",
        "starlark": "star bzl bazel bzlmod BUILD WORKSPACE",
        "swift": "swift",
        "toml": "toml",
        "typescript": "d.ts ts",
        "tsx": "tsx",
        "xml": "xml",
        "yaml": "yml yaml",
    }.items()
    for ext in exts.split()
}


def format_name(path: str, remap: dict[str, str] | None = None) -> str | None:
    """The format of a path: the shortest suffix after a dot that is known, at last the whole name; None if none is."""
    parts = path.rsplit("/", 1)[-1].split(".")
    for k in range(len(parts) - 1, -1, -1):
        tail = ".".join(parts[k:])
        if found := EXTENSIONS.get((remap or {}).get(tail, tail)):
            return found
    return None


class Lines:
    """Positions (line, column), both from 1 and columns in bytes, of offsets in a file."""

    def __init__(self, src: bytes):
        # the last start is past the end, where no offset is
        self.starts = [0, *accumulate(map((1).__add__, map(len, src.split(b"\n"))))]

    def position(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1


def comments(src: bytes, name: str) -> list[tuple[int, int, bytes]]:
    """(start, end, text) of the comments of a file in the format ``name``, in order."""
    fmt = FORMATS[name]
    return fmt.own(src) if fmt.own else scan(fmt, src)
