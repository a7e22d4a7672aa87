"""Source trees as tables.

``RepoFiles`` lists a tree on the driver, honouring ignore files and skipping hidden
entries, and reads the files in parallel tasks. Spark's own readers hide names that
begin with an underscore, which would lose every ``__init__.py``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.lexers import format_name
from ..functions.text import glob_regex
from ..operators.schemas import FILES

FILES_PER_TASK = 256


def find_root(start: str = ".") -> str:
    """The nearest folder, from ``start`` upwards, that holds a version-control folder."""
    at = os.path.abspath(start)
    while True:
        if any(os.path.isdir(os.path.join(at, d)) for d in (".git", ".hg")):
            return at
        up = os.path.dirname(at)
        if up == at:
            raise FileNotFoundError(f"no repository root above {start}")
        at = up


def contained(root: str, path: str) -> str:
    """The real location of ``path`` under ``root``; ValueError if it leads outside."""
    base = os.path.realpath(root)
    real = os.path.realpath(os.path.join(base, path))
    if os.path.commonpath([base, real]) != base:
        raise ValueError(f"{path!r} is outside the root {root!r}")
    return real


class IgnoreRules:
    """The patterns of one ignore file; later ones win, a leading ``!`` takes back.

    ``base`` is the file's folder below the root of the walk; ``inner``, for a file above it, the root below the file's folder.
    """

    def __init__(self, base: str, text: str, inner: str = "."):
        self.base, self.rules = base, []
        self.inner = "" if inner == "." else inner.replace(os.sep, "/") + "/"
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:].removeprefix("\\")
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            out = ""
            for part in re.split(r"(\*\*/|/\*\*$|\*|\?|\[[^\]]*\])", line.lstrip("/")):
                out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part[:1] == "[" else re.escape(part))
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), folder, not keep))

    def decide(self, path: str, is_dir: bool) -> bool | None:
        rel = self.inner + (path[len(self.base) :].lstrip("/") if self.base else path)
        for rule, folder, ignored in reversed(self.rules):
            if (is_dir or not folder) and rule.match(rel):
                return ignored
        return None


def _lines_of(path: str) -> str:
    if not os.path.isfile(path):
        return ""
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def _outer_rules(root: str) -> list[IgnoreRules]:
    """What applies to a tree from outside of it: the user's ignore file, the repository's own, and those of the folders above, up to the repository's root."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    out = [IgnoreRules("", _lines_of(os.path.join(home, "git", "ignore")))]
    try:
        top = find_root(root)
    except FileNotFoundError:
        return out
    out.append(IgnoreRules("", _lines_of(os.path.join(top, ".git", "info", "exclude")), os.path.relpath(os.path.abspath(root), top)))
    at = top
    for part in os.path.relpath(os.path.abspath(root), top).split(os.sep):
        if os.path.abspath(at) == os.path.abspath(root):
            break
        inner = os.path.relpath(os.path.abspath(root), at)
        out += [IgnoreRules("", _lines_of(os.path.join(at, name)), inner) for name in (".gitignore", ".ignore")]
        at = os.path.join(at, part)
    return out


def walk(root: str) -> Iterator[str]:
    """Relative paths of all files that aren't hidden or ignored, in order; errors are raised."""

    def visit(rel: str, rules: list[IgnoreRules]) -> Iterator[str]:
        here = os.path.join(root, rel)
        for name in (".gitignore", ".ignore"):
            if os.path.isfile(os.path.join(here, name)):
                with open(os.path.join(here, name), encoding="utf-8", errors="replace") as f:
                    rules = [*rules, IgnoreRules(rel, f.read())]
        with os.scandir(here) as entries:
            found = sorted(entries, key=lambda e: e.name)
        for e in found:
            if e.name.startswith("."):
                continue
            path = f"{rel}/{e.name}" if rel else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            verdict = next((v for r in reversed(rules) if (v := r.decide(path, is_dir)) is not None), False)
            if verdict:
                continue
            if is_dir:
                yield from visit(path, rules)
            elif e.is_file():
                yield path

    yield from visit("", _outer_rules(root))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.globs = [g for g in options.get("globs", "").split("\n") if g]
        self.ignore = [g for g in options.get("ignore", "").split("\n") if g]
        self.only = options.get("only")
        self.remap = dict(x.split("=", 1) for x in options.get("extensions", "").split("\n") if x) if "extensions" in options else None

    def partitions(self):
        allow, deny = ([re.compile(glob_regex(g)) for g in gs] for gs in (self.globs, self.ignore))
        paths = self.only.split("\n") if self.only is not None else walk(self.root)
        known = (lambda p: format_name(p, self.remap)) if self.remap is not None else bool
        kept = [p for p in paths if p and known(p) and (not allow or any(g.search(p) for g in allow)) and not any(g.search(p) for g in deny)]
        return [_Files(kept[i : i + FILES_PER_TASK]) for i in range(0, len(kept), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            with open(contained(self.root, path), encoding="utf-8", newline="") as f:
                yield path, f.read()


class RepoFiles(DataSource):
    """``spark.read.format("repo_files").load(root)``, with options globs, ignore, only (paths) and extensions, one a line.

    With ``extensions`` (``KEY=VALUE``, or empty), files without a known format aren't opened.
    """

    @classmethod
    def name(cls):
        return "repo_files"

    def schema(self):
        return FILES

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_repo(spark: SparkSession, root: str, globs: list[str] | None = None, ignore: list[str] | None = None, paths: list[str] | None = None, extensions: dict[str, str] | None = None) -> DataFrame:
    """path, content of the files of a tree, or of ``paths`` alone, that have a known format; all of this is decided before anything is read."""
    spark.dataSource.register(RepoFiles)
    reader = spark.read.format("repo_files").option("globs", "\n".join(globs or [])).option("ignore", "\n".join(ignore or []))
    reader = reader.option("extensions", "\n".join(f"{k}={v}" for k, v in (extensions or {}).items()))
    return (reader.option("only", "\n".join(paths)) if paths is not None else reader).load(root)


def in_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), FILES)


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """text of the diffs in a file or folder, one a row."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def diff_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string")
