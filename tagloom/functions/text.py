"""Text functions: globs, regular-expression dialects, trimming, lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode calls white space, written out, since engines disagree on their shorthands.
SPACES = "\\t\\n\\x0B\\f\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
PY_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression; stars cross directory separators."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            if glob.startswith("*/", at) and (at == 1 or glob[at - 2] == "/"):
                out, at = out + "(?:.*/)?", at + 2
            else:
                while glob.startswith("*", at):
                    at += 1
                out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", at + 2 if glob[at : at + 1] in ("!", "^") else at + 1)
            if end < 0:
                raise ValueError(f"unclosed character class in glob {glob!r}")
            body = glob[at:end].replace("\\", "\\\\").replace("[", "\\[")
            out, at = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "{":
            out += "(?:"
        elif c == "}":
            out += ")"
        elif c == "," and out.count("(?:") > out.count(")"):
            out += "|"
        elif c == "\\" and at < len(glob):
            out, at = out + re.escape(glob[at]), at + 1
        else:
            out += re.escape(c)
    re.compile(out)
    return f"(?s)^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out
