"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, scheme separators,
identifier cues, and the digit pairs that any address or account number has. From each
anchor a deterministic local parser expands to the longest candidate and validates it:

* ``url``: only addresses that identify a person (user info, or a query naming one);
* ``email``: local part and domain of the at-sign, label by label;
* ``ip``: four octets without leading zeros, or a full or shortened address of eight
  groups, except loopback and unspecified;
* ``secret``: the value that follows a cue such as "token" or "password" and ``=`` or ``:``;
* ``phone``: international numbers of 8 to 15 digits, or 3-3-4 groups;
* ``card``: 13 to 19 digits with a card prefix and a check digit, alone or in groups of four;
* ``iban``: country, check digits modulo 97; ``ssn``: 3-2-4 groups in valid ranges;
* ``account``: 6 to 19 digits that follow a cue such as "account" or "iban".

Spans never overlap; of two candidates the one whose kind is named first above stands.
Positions count characters from 0 and ends are exclusive. Every run of characters that a
parser may expand over is measured once, whatever number of anchors it holds, so the time
is proportional to the length of a text. Postal addresses are beyond this operator.

Defined cases: a null or empty text has no spans and stays as it is; repeated rows give
repeated results; null ids are kept; texts of any length are read whole; other columns
are untouched whatever their names; ``n_chars``, if it is an integer column, follows the text.
"""

from __future__ import annotations

import ipaddress
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import Disjoint
from .words import slices

CUES = ("account", "acct", "iban", "konto", "cuenta", "compte", "card", "customer id", "passport")
SECRET_CUES = ("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "api-key", "access_key", "secret_key", "private_key")
SCHEMES = ("http", "https", "ftp", "sftp", "ssh", "postgres", "postgresql", "mysql", "mongodb", "redis")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
_GROUPS = frozenset("0123456789abcdefABCDEF:")
_PERSONAL = re.compile(r"[?&](?:user|username|email|mail|login|account|phone|ssn|token|session)=", re.I)
_URL_END = re.compile(r"[\s<>\"'`{}|\\^]")
_CARD = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}")
_PHONE = re.compile(r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4})(?:[ .-]?\d{2,4}){1,4}|(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}")
_MORE = re.compile(r"\w|\.\d")
_IBAN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
_ACCOUNT = re.compile(r"(?:\s{1,9}(?:no|number|nr|num)\b\.?)?[\s:#=.-]{1,4}(\d(?:[ -]?\d){5,18})(?!\w)")
_SECRET = re.compile(r"[\"']?\s{0,9}[=:]\s{0,9}[\"']?([^\s\"',;<>]{6,})")
_NUMBER_RUN = re.compile(r"[0-9.]+")
_GROUP_RUN = re.compile(r"[0-9a-fA-F:]+")
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    n: k
    for k, of in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 33: "RU", 32: "LC",
    }.items()
    for n in of.split()
}
_RANK = {k: i for i, k in enumerate(("url", "email", "ip", "secret", "iban", "card", "ssn", "phone", "account"))}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", (0, 1))
    a.add_word("://", (1, 3))
    a.add_word("::", (4, 2))
    for x in range(10):
        a.add_word(f"{x}.", (2, 2))
        for y in range(10):
            a.add_word(f"{x}{y}", (2, 2))
    for cue in CUES:
        a.add_word(cue, (3, len(cue)))
    for cue in SECRET_CUES:
        a.add_word(cue, (5, len(cue)))
    a.make_automaton()
    return a


def _word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def email_at(text: str, at: int) -> tuple[str, int, int] | None:
    """The address around the at-sign."""
    a = at
    while a > 0 and at - a < 65 and text[a - 1] in _LOCAL:
        a -= 1
    while a < at and text[a] in ".-%+":
        a += 1
    b = at + 1
    while b < len(text) and b - at < 255 and text[b] in _DOMAIN:
        b += 1
    labels = text[at + 1 : b].split(".")
    while labels and not labels[-1].strip("-"):
        labels.pop()
    labels = [*labels[:-1], labels[-1].rstrip("-")] if labels else labels
    while len(labels) > 2 and not (labels[-1].isalpha() and len(labels[-1]) > 1):
        labels.pop()
    local = text[a:at]
    if not local or len(local) > 64 or ".." in local or local[-1] == "." or len(labels) < 2 or len(labels[-1]) < 2 or not labels[-1].isalpha():
        return None
    if any(not x or len(x) > 63 or x[0] == "-" or x[-1] == "-" for x in labels):
        return None
    return "email", a, at + 1 + len(".".join(labels))


class Urls:
    """Addresses around scheme separators, in the order of a text; each run without a space is measured once."""

    def __init__(self, text: str):
        self.text, self.stop, self.end, self.query = text, -1, 0, -1

    def at(self, at: int) -> tuple[str, int, int] | None:
        """The address around the separator, if it identifies a person."""
        text = self.text
        a = at
        while a > 0 and at - a < 12 and text[a - 1].isascii() and text[a - 1].isalnum():
            a -= 1
        if text[a:at].lower() not in SCHEMES:
            return None
        if at >= self.stop:
            m = _URL_END.search(text, at + 3)
            self.stop = self.end = m.start() if m else len(text)
            while self.end > at + 3 and text[self.end - 1] in ".,;:!?)]":
                self.end -= 1
            self.query = max((m.start() for m in _PERSONAL.finditer(text, at + 3, self.end)), default=-1)
        slash = text.find("/", at + 3, self.end)
        host = slash if slash >= 0 else self.end
        if host <= at + 3:
            return None
        return ("url", a, self.end) if self.query >= at + 3 or text.find("@", at + 3, host) >= 0 else None


def mod97(iban: str) -> bool:
    x = iban.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def luhn(number: str) -> bool:
    """Whether the last digit checks the others, as in all card numbers."""
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


class Groups:
    """Addresses of hexadecimal groups, in the order of a text; each run of them is measured once."""

    def __init__(self, text: str):
        self.text, self.stop = text, 0

    def at(self, at: int) -> tuple[str, int, int] | None:
        """The address around a character in it, unless its run was looked at before."""
        text = self.text
        if at < self.stop:
            return None
        a = at
        while a > self.stop and text[a - 1] in _GROUPS:
            a -= 1
        b = self.stop = _GROUP_RUN.match(text, a).end()
        while b > a and text[b - 1] == ":" and text[b - 2 : b] != "::":
            b -= 1
        if not 6 <= b - a <= 39 or _word(text, a - 1) or _word(text, b) or text.count(":", a, b) < 2:
            return None
        found = text[a:b]
        if not any(c.isdigit() for c in found):
            return None
        try:
            known = ipaddress.IPv6Address(found)
        except ValueError:
            return None
        return None if known.is_loopback or known.is_unspecified else ("ip", a, b)


def number_in(text: str, a: int, b: int, groups: Groups) -> tuple[str, int, int] | None:
    """The address or account number around the run of digits and dots from a to b."""
    run = text[a:b].strip(".") if b - a < 64 else ""
    lead = len(text[a:b]) - len(text[a:b].lstrip("."))
    octets = run.split(".")
    if len(octets) == 4 and not _word(text, a + lead - 1) and not _word(text, a + lead + len(run)):
        if all(x.isdigit() and x.isascii() and len(x) <= 3 and int(x) < 256 and (x == "0" or x[0] != "0") for x in octets) and octets[0] not in ("0", "127"):
            return "ip", a + lead, a + lead + len(run)
    a += lead
    if text[b : b + 1] == ":" or text[a - 1 : a] == ":":
        if got := groups.at(a):
            return got
    c = a - 2
    if c >= 0 and not _word(text, c - 1) and (long := IBAN_LENGTHS.get(text[c:a])) and (m := _IBAN.match(text, c)):
        # every country has one length; spaces between groups come on top
        stop = c
        for _ in range(long):
            stop += 1 + (text[stop : stop + 1] == " ")
        if stop <= m.end() and mod97(text[c:stop]) and not _word(text, stop):
            return "iban", c, stop
    if not _word(text, a - 1):
        if (m := _CARD.match(text, a)) and not _MORE.match(text, m.end()) and text[a] in "23456" and luhn(m.group()):
            return "card", a, m.end()
        if (m := _SSN.match(text, a)) and not _MORE.match(text, m.end()) and text[a - 1 : a] not in ("-", "."):
            return "ssn", a, m.end()
    starts: list[int] = []
    before = text[max(0, a - 7) : a]
    if "+" in before or "(" in before:
        for c in range(a - 1, max(-1, a - 8), -1):
            if text[c] not in "0123456789 ()+.-":
                break
            if text[c] in "+(":
                starts.append(c)
    for c in [*reversed(starts), a]:
        if (m := _PHONE.match(text, c)) and m.end() > a and not _word(text, c - 1) and not _word(text, m.end()) and 8 <= sum(x.isdigit() for x in m.group()) <= 15:
            return "phone", c, m.end()
    return None


def find(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), in order."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found, done, tried, value_done = [], -1, -1, -1
    urls, groups = Urls(text), Groups(text)
    for end, (what, n) in anchors.iter(low):
        at = end + 1 - n
        got = None
        if what == 2:
            # every anchor of one run of digits and dots leads to the same candidate
            if at < done or at < tried:
                continue
            a = at
            while a > max(tried, 0) and text[a - 1] in "0123456789.":
                a -= 1
            tried = _NUMBER_RUN.match(text, a).end()
            got = number_in(text, a, tried, groups)
            if got:
                done = max(done, got[2])
        elif what == 0:
            got = email_at(text, at)
        elif what == 1:
            got = urls.at(at)
        elif what == 4:
            got = groups.at(at)
        elif what == 5:
            # a value runs to the next space or quote, so a cue inside of one is part of it
            m = None if at < value_done or (at and text[at - 1].isalnum()) else _SECRET.match(text, end + 1)
            if m:
                got, value_done = ("secret", m.start(1), m.end(1)), m.end(1)
        else:
            m = None if _word(text, at - 1) else _ACCOUNT.match(text, end + 1)
            got = ("account", m.start(1), m.end(1)) if m else None
        if got:
            found.append(got)
    taken = Disjoint()
    ranked = sorted(set(found), key=lambda s: (_RANK[s[0]], s[1] - s[2], s[1]))
    return sorted((s for s in ranked if taken.add(s[1], s[2])), key=lambda s: s[1])


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, stop, value of every span."""

    def run(batches):
        anchors = automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(i, k, a, b, t[a:b]) for i, t in enumerate(part.column(1).to_pylist()) for k, a, b in find(t, anchors)]
                if rows:
                    col = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(col[0])), pa.array(col[1]), pa.array(col[2], pa.int64()), pa.array(col[3], pa.int64()), pa.array(col[4])], ["doc_id", "kind", "start", "stop", "value"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, kind string, start bigint, stop bigint, value string")


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind."""
    at = docs.columns.index("text")
    sized = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType))

    def run(batches):
        anchors = automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                texts, changed = part.column(at).to_pylist(), {}
                for i, t in enumerate(texts):
                    if spans := find(t, anchors):
                        changed[i] = redact(t, spans)
                columns = list(part.columns)
                if changed:
                    columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[at].type)
                    if sized:
                        k = part.schema.get_field_index("n_chars")
                        columns[k] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[k].to_pylist())], columns[k].type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
