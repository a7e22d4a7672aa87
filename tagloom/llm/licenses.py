"""License scan by conditional compression.

What lies near cue words forms candidate blocks; each sentence with a cue is a candidate
too. Long blocks are cut into overlapping pieces, so that a template's
whole text lies in one. A candidate is compressed in lower case once on its own and once with
each license template as a raw Zstandard dictionary: the more of it the template explains,
the smaller the second result. Templates are ranked by the relative reduction, and all are
confirmed in this order by the exact differences in wording between template and candidate:
words of the template that are missing or changed, and words put in between. A template is
confirmed if these are at most ``TOLERANCE`` of its words and none of them is *decisive*:
versions and other words with digits, names and kinds of licenses, and negations make another
license or none. The same holds for what goes with the wording: a negation just before it,
or "or later" just after. A template within the tolerance always has three words in a row
intact, in so many places that others needn't be compressed with or compared; nothing else
limits what is confirmed. Of overlapping confirmed spans the one that explains most words
stands, of equals the one with fewest differences, then the best reduction.

Defined cases: null and empty texts have no candidates; repeated rows give repeated
results; null ids are kept; a text without line breaks is cut around its cues, so the time
is proportional to its length; ties in reduction go to the longer template, then the smaller
name; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from difflib import SequenceMatcher

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS, templates
from .spans import Disjoint
from .words import slices

TOLERANCE, MARGIN, LEVEL, GRAM = 0.15, 1200, 9, 3
CUES = ("licens", "licenc", "copyright", "warrant", "spdx", "rights reserved", "public domain", "redistribut", "permission", "liabil", "merchantab", "gnu ", "creative commons", "cc by", "cc-by", "cc0", "prohibited", "misrepresented", "wtfpl", "eupl")
TEMPLATES = templates()
__all__ = ["TEMPLATES", "TEXTS", "Scanner", "find_licenses"]
#: Longer than the text of any template as it is written, with line breaks and comment signs.
PIECE_OVERLAP = 2 * max(len(t) for texts in TEMPLATES.values() for t in texts)
PIECE = 3 * PIECE_OVERLAP
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
NEGATIONS = frozenset(("not", "no", "never", "isn", "aren", "wasn", "cannot", "neither", "unless", "without", "longer", "formerly", "previously"))
DECISIVE = NEGATIONS | frozenset(
    "mit apache bsd isc gpl lgpl agpl gnu general lesser library affero mozilla eclipse boost zlib artistic python font unlicense wtfpl simplified new clear zero attribution sharealike noncommercial noderivatives noderivs only later commercial free public domain".split()
    + ["creative", "commons", "cc", "by", "european", "sil", "cddl", "attribution-sharealike", "attribution-noncommercial", "attribution-noderivatives", "attribution-noncommercial-sharealike", "attribution-noncommercial-noderivatives", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
)


def decisive(word: str) -> bool:
    return word in DECISIVE or any(c.isdigit() for c in word)


def lowered(text: str) -> str:
    """Lower case that keeps every character's position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(lowered(text))]


def allowed(n: int) -> int:
    """Differences that a template of ``n`` words may have."""
    return int(TOLERANCE * n)


class Scanner:
    """Compressors, words and runs of words of all templates; made once in a task."""

    def __init__(self, texts: dict[str, tuple[str, ...]] = TEMPLATES):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.cues = ahocorasick.Automaton()
        for cue in CUES:
            self.cues.add_word(cue, len(cue))
        self.cues.make_automaton()
        self.templates: list[tuple[str, list[str]]] = []
        self.raw: list[bytes] = []
        self.packers: dict[int, zstandard.ZstdCompressor] = {}
        self.grams: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for name, own in texts.items():
            for text in own:
                words = [w for w, _, _ in words_of(text)]
                for k in range(max(1, len(words) - GRAM + 1)):
                    self.grams[tuple(words[k : k + GRAM])].append((len(self.templates), k))
                self.templates.append((name, words))
                self.raw.append(lowered(text).encode())
        self.sizes = sorted({len(g) for g in self.grams}, reverse=True)

    def packer(self, i: int) -> zstandard.ZstdCompressor:
        if i not in self.packers:
            d = zstandard.ZstdCompressionDict(self.raw[i], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.packers[i] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self.packers[i]

    def places(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Where in ``words`` templates may stand, as (first, behind the last) word: wherever enough runs of their words are intact."""
        hits: dict[int, list[int]] = defaultdict(list)
        for size in self.sizes:
            for at in range(len(words) - size + 1):
                for i, k in self.grams.get(tuple(words[at : at + size]), ()):
                    hits[i].append(at - k)
        out = {}
        for i, offsets in hits.items():
            n = len(self.templates[i][1])
            d = allowed(n)
            # a difference breaks at most as many runs as a run has words, and moves what follows by one at most
            need = max(1, n - min(GRAM, n) + 1 - GRAM * d)
            offsets.sort()
            found: list[list[int]] = []
            low = 0
            for high, offset in enumerate(offsets):
                while offset - offsets[low] > 2 * d:
                    low += 1
                if high - low + 1 >= need:
                    a, b = max(0, offsets[low] - d), min(len(words), offset + n + d)
                    if found and a <= found[-1][0] + d:
                        found[-1][1] = max(found[-1][1], b)
                    else:
                        found.append([a, b])
            if found:
                out[i] = [(a, b) for a, b in found]
        return out

    def reductions(self, block: str, of: list[int]) -> list[tuple[float, int]]:
        """(relative reduction, template) of the templates ``of``, largest first."""
        if not of:
            return []
        raw = lowered(block).encode()
        alone = len(self.plain.compress(raw))
        got = [(round(1 - len(self.packer(i).compress(raw)) / alone, 6), i) for i in of]
        return sorted(got, key=lambda r: (-r[0], -len(self.templates[r[1]][1]), self.templates[r[1]][0]))

    def wording(self, words: list[str], template: list[str], a: int, b: int) -> tuple[int, int, int, int] | None:
        """missing, added words and the word span of the template in words[a:b]; None if it isn't that template."""
        same = [x for x in SequenceMatcher(None, words[a:b], template, autojunk=False).get_matching_blocks() if x.size]
        if not same:
            return None
        first, last = same[0].a + a, same[-1].a + same[-1].size + a
        matched = sum(x.size for x in same)
        missing, added = len(template) - matched, last - first - matched
        if missing + added > allowed(len(template)):
            return None
        kept, covered = set(), set()
        for x in same:
            kept.update(range(x.b, x.b + x.size))
            covered.update(range(x.a + a, x.a + a + x.size))
        if any(decisive(w) for k, w in enumerate(template) if k not in kept) or any(decisive(words[k]) for k in range(first, last) if k not in covered):
            return None
        if not NEGATIONS.isdisjoint(words[max(0, first - 2) : first]) and template[0] not in ("all", "this"):
            return None
        if words[last : last + 2] == ["or", "later"] or words[last : last + 3] == ["or", "any", "later"]:
            return None
        return missing, added, first, last

    def scan(self, text: str | None) -> list[tuple[str, int, int, float, int, int]]:
        """license, start, stop, reduction, missing, added of the confirmed licenses of a text."""
        if not text:
            return []
        cues = sorted(end + 1 - n for end, n in self.cues.iter(lowered(text)))
        found = set()
        for a, b in candidates(text, cues):
            block = text[a:b]
            words = words_of(block)
            plain = [x for x, _, _ in words]
            places = self.places(plain)
            for cut, i in self.reductions(block, list(places)):
                name, template = self.templates[i]
                for first, behind in places[i]:
                    if w := self.wording(plain, template, first, behind):
                        found.add((len(template) - w[0], cut, name, a + words[w[2]][1], a + words[w[3] - 1][2], w[0], w[1]))
        out: list[tuple[str, int, int, float, int, int]] = []
        taken = Disjoint()
        for _, cut, name, a, b, missing, added in sorted(found, key=lambda f: (-f[0], f[5] + f[6], -f[1], f[2], f[3])):
            if taken.add(a, b):
                out.append((name, a, b, cut, missing, added))
        return sorted(out, key=lambda o: o[1])


_SENTENCE = re.compile(r"[.!?:;]\s")
_STOP = re.compile(r"[.!?](?=\s(?!\s*\d)|$)")


def candidates(text: str, cues: list[int]) -> list[tuple[int, int]]:
    """Spans to compress: all within ``MARGIN`` characters of cues, in pieces, and sentences with cues."""
    spans: set[tuple[int, int]] = set()
    blocks: list[list[int]] = []
    done = 0
    for c in cues:
        a, b = max(0, c - MARGIN), min(len(text), c + MARGIN)
        if blocks and a <= blocks[-1][1]:
            blocks[-1][1] = b
        else:
            blocks.append([a, b])
        if c < done:
            continue  # in the sentence of the cue before
        begin = max(text.rfind("\n", a, c) + 1, a, done)
        end = text.find("\n", c, b)
        s = max((m.end() for m in _SENTENCE.finditer(text, begin, c)), default=begin)
        e = _STOP.search(text, c, b if end < 0 else end)
        done = e.end() if e else b if end < 0 else end
        spans.add((s, done))
    for a, b in blocks:
        spans |= {(x, min(x + PIECE, b)) for x in range(a, max(a + 1, b - PIECE_OVERLAP), PIECE - PIECE_OVERLAP)}
    return sorted(spans)


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, license, start, stop, reduction, missing, added of all confirmed licenses."""

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(i, *x) for i, t in enumerate(part.column(1).to_pylist()) for x in scanner.scan(t)]
                if rows:
                    i, name, a, b, cut, missing, added = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(name), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cut, pa.float64()), pa.array(missing, pa.int32()), pa.array(added, pa.int32())], ["doc_id", "license", "start", "stop", "reduction", "missing", "added"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, license string, start bigint, stop bigint, reduction double, missing int, added int")
