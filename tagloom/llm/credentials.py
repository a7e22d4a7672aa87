"""Secret scan with multipart credential linking.

Credentials come in parts: access identifiers, secrets and endpoints. Parts are found by
pattern. A *strong* part is unmistakable by its form (an access key id, a private key, a
vendor's token) and is reported in any case; a *weak* one (a password assignment, a user
name, a host) only together with a complementary part. Names may be quoted, as in JSON; a
URL with user info is an identifier, a secret and an endpoint. A private key reaches to its
END line. Values of any length are read to their end.

Parts are linked in their whole document, at any distance: each identifier with each secret,
each endpoint with each secret and with each strong identifier. ``linked`` gives a row for
every part that is strong or has a link, with the number of its links; pairs, whose number
may grow with the square of the text, aren't written out. None is lost: all pairs of distinct
rows of one doc_id and row_key whose roles link are the links, and spans give their distance.
How many lie in the scope of a part, ``SCOPE`` characters before its start and after its end,
and the nearest partner of each role, at any distance, are told beside.

A document's parts are disjoint, so in order of position both their starts and their ends
rise, and the parts in a scope are a run of them: scopes are joined as intervals by one
sweep over the sorted parts, in the task that reads the document, without any shuffle. A run
is counted by its ends, so ``linked`` costs what the text costs, however many parts it has.

``credentials`` writes out the pairs within a scope, and those alone: each identifier with
each secret in scope, each secret that has no identifier but an endpoint in scope, and
strong parts that have neither. An endpoint in scope of the secret (else of the identifier)
is added: the nearest, of equals the first. What lies within ``SCOPE`` characters is bounded
by the length of the shortest part, so these pairs are in proportion to the text, too.

Defined cases: null and empty texts have no parts; repeated rows give repeated results; null
ids are kept; long texts are read whole; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key
from .spans import Disjoint
from .words import slices

SCOPE = 400
#: Length of the longest mask; longer secrets show no more stars.
SHOWN = 200
#: Between a name and its value; the name may be quoted, as in JSON.
_IS = r"[\"']?\s*[=:]\s*[\"']?"
_VALUE = r"([^\s\"',;<>]{6,})"
#: A character of a URL's user info, which ends at the last @ before the path.
_USER = r"[^\s\"'<>/?#]"
#: Role, whether strong, the pattern, and what the lower-cased text of a match has one of.
PATTERNS = (
    ("id", False, r"://([^\s\"'<>/?#:@]+)(?::" + _USER + r"*)?@", ("://",)),
    ("secret", False, r"://[^\s\"'<>/?#:@]*:(" + _USER + r"+)@", ("://",)),
    ("endpoint", False, r"://" + _USER + r"*@([A-Za-z0-9\[][^\s\"'<>@]{2,})", ("://",)),
    ("id", True, r"(?<![A-Za-z0-9])((?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16})(?![A-Za-z0-9])", ("akia", "asia", "aroa", "aida")),
    ("id", False, r"(?i)(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|account_?id|access_?key_?id)" + _IS + r"([A-Za-z0-9_.@-]{3,})", ("user", "login", "client", "account", "access")),
    ("id", False, r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", ("@",)),
    ("secret", True, r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])", ("gh", "xox", "sk_live_", "aiza")),
    ("secret", True, r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END (?:[A-Z]+ )?PRIVATE KEY-----)?)", ("-----begin",)),
    ("secret", False, r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|secret(?:_?key)?|token|api_?key|access_?key)" + _IS + _VALUE, ("passw", "pwd", "secret", "token", "key")),
    ("endpoint", False, r"(?<![A-Za-z0-9.])((?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis)://[^\s\"'<>]{4,})", ("://",)),
    ("endpoint", False, r"(?<![A-Za-z0-9.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?::\d{2,5})?)(?![A-Za-z0-9]|\.\d)", None),
    ("endpoint", False, r"(?i)(?<![A-Za-z0-9])(?:host(?:name)?|endpoint|server)" + _IS + r"([A-Za-z0-9.-]{3,})", ("host", "endpoint", "server")),
)
_DOTTED = r"\d\.\d{1,3}\.\d"

Part = tuple[str, bool, int, int, str]


def compiled_patterns() -> list:
    return [(role, strong, re.compile(p), needs) for role, strong, p, needs in PATTERNS] + [re.compile(_DOTTED)]


def parts_of(text: str | None, compiled: list) -> list[Part]:
    """role, strong, start, stop, value of the parts of a text; of overlapping parts the strong, then the first pattern's stands."""
    if not text:
        return []
    found = []
    low = text.lower()
    for n, (role, strong, pattern, needs) in enumerate(compiled[:-1]):
        if any(x in low for x in needs) if needs else compiled[-1].search(text):
            found += [(not strong, n, m.start(1), m.end(1), role, m.group(1)) for m in pattern.finditer(text)]
    out: list[Part] = []
    taken = Disjoint()
    for weak, _, a, b, role, value in sorted(found):
        if taken.add(a, b):
            out.append((role, not weak, a, b, value))
    return sorted(out, key=lambda p: p[2])


class _Sorted:
    """The parts of one role, in order, for looking up those in a scope."""

    def __init__(self, parts: list[Part], role: str):
        self.parts = [p for p in parts if p[0] == role]
        self.starts, self.stops = [p[2] for p in self.parts], [p[3] for p in self.parts]

    def within(self, a: int, b: int, scope: int) -> range:
        """Numbers of the parts whose gap to the span is at most ``scope``."""
        return range(bisect_left(self.stops, a - scope), bisect_right(self.starts, b + scope))

    def nearest(self, a: int, b: int, scope: float) -> Part | None:
        """The part in scope of the span with the smallest gap, of equals the first."""
        right = bisect_left(self.starts, a)
        near = [(max(p[2] - b, a - p[3], 0), p[2], p) for p in self.parts[max(0, right - 1) : right + 1]]
        gap, _, p = min(near, default=(scope + 1, 0, None))
        return p if gap <= scope else None


def links(parts: list[Part], scope: int) -> list[tuple[str, Part | None, Part | None, Part | None]]:
    """strength, identifier, secret and endpoint of the credentials of one document's parts."""
    ids, secrets, ends = (_Sorted(parts, role) for role in ("id", "secret", "endpoint"))
    cores: list[tuple[Part | None, Part | None]] = []
    used = set()
    for i in ids.parts:
        near = secrets.within(i[2], i[3], scope)
        used.update(near)
        cores += [(i, secrets.parts[k]) for k in near]
        if not near and i[1]:
            cores.append((i, None))
    cores += [(None, s) for k, s in enumerate(secrets.parts) if k not in used]
    out = []
    for i, s in cores:
        at = s or i
        end = ends.nearest(at[2], at[3], scope)
        strong, linked = bool(i and i[1] or s and s[1]), bool(i and s or end)
        if strong or linked:
            out.append(("strong, linked" if strong and linked else "strong" if strong else "linked", i, s, end))
    return out


ROLES = ("id", "secret", "endpoint")


def partners(parts: list[Part], scope: int) -> list[tuple[Part, str, list[int | None], int, int]]:
    """Each of one document's parts that is strong or has a link: itself, strength, starts of the nearest partners by role (in its own role its own), number of links, of those in scope."""
    ids, secrets, ends = (_Sorted(parts, role) for role in ROLES)
    strong_ids = _Sorted([p for p in parts if p[1]], "id")
    none = _Sorted([], "id")
    out = []
    for p in parts:
        role, strong, a, b, _ = p
        if role == "id":
            others = none, secrets, ends if strong else none
        elif role == "secret":
            others = ids, none, ends
        else:
            others = strong_ids, secrets, none
        n = sum(len(o.parts) for o in others)
        if strong or n:
            near = sum(len(o.within(a, b, scope)) for o in others)
            first = [p if r == role else o.nearest(a, b, math.inf) for r, o in zip(ROLES, others)]
            out.append((p, "strong, linked" if strong and n else "strong" if strong else "linked", [q and q[2] for q in first], n, near))
    return out


def masked(value: str) -> str:
    shown = 4 if len(value) > 5 else 0
    return value[:shown] + "*" * (min(len(value), SHOWN) - shown)


_LINKED = "doc_id bigint, row_key bigint, role string, strength string, value string, start bigint, stop bigint, id_start bigint, secret_start bigint, endpoint_start bigint, links bigint, links_in_scope bigint"
_RESULT = "doc_id bigint, strength string, access_id string, id_start bigint, secret string, secret_start bigint, endpoint string, endpoint_start bigint"
_KINDS = {"bigint": pa.int64(), "string": pa.string()}


def _of_parts(docs: DataFrame, keys: list[Column], found: Callable[[list[Part]], list[tuple]], result: str) -> DataFrame:
    """The columns ``keys`` of each row, with each of the tuples that ``found`` gives for the parts of its text."""

    def run(batches):
        compiled = compiled_patterns()
        names, kinds = map(list, zip(*(f.split() for f in result.split(", "))))
        for batch in batches:
            for part in slices(batch, "text"):
                at, rows = [], []
                for k, text in enumerate(part.column(0).to_pylist()):
                    new = found(parts_of(text, compiled))
                    at += [k] * len(new)
                    rows += new
                if rows:
                    own = [part.column(n).take(pa.array(at)) for n in range(1, part.num_columns)]
                    yield pa.RecordBatch.from_arrays(own + [pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows), kinds[len(own) :])], names)

    return docs.select(F.col("text").cast("string").alias("text"), *keys).mapInArrow(run, result)


def linked(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, row_key, role, strength, value, span, starts of nearest partners and numbers of links of all parts that are strong or have a link; secrets are masked."""

    def found(parts: list[Part]) -> list[tuple]:
        return [(p[0], strength, masked(p[4]) if p[0] == "secret" else p[4], p[2], p[3], *starts, n, near) for p, strength, starts, n, near in partners(parts, scope)]

    return _of_parts(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key")], found, _LINKED)


def credentials(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, strength, access_id, id_start, secret, secret_start, endpoint, endpoint_start of all credentials within a scope; secrets are masked."""

    def found(parts: list[Part]) -> list[tuple]:
        return [(strength, i and i[4], i and i[2], s and masked(s[4]), s and s[2], e and e[4], e and e[2]) for strength, i, s, e in links(parts, scope)]

    return _of_parts(docs, [F.col("doc_id").cast("bigint").alias("doc_id")], found, _RESULT)
