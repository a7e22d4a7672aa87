"""Plans of the two commands: validate and list."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexers import EXTENSIONS
from ..functions.text import matches_any
from ..operators import validators as v
from ..operators.changes import diff_changes, mark_modified
from ..operators.extract import extract_blocks
from ..operators.local import LOCAL, local_checks
from ..operators.schemas import CHANGES, UNNAMED

VALIDATORS = ("affects", "keep-sorted", "keep-unique", "line-pattern", "line-count", "check-ai", "check-lua")


class ValidationError(Exception):
    """A run that can't go on; there is no partial report."""


@dataclass
class Options:
    globs: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    extensions: dict[str, str] = field(default_factory=dict)
    enable: list[str] = field(default_factory=list)
    disable: list[str] = field(default_factory=list)
    ai_client: Callable[[str, str], str] | None = None
    scripts: dict[str, v.Checker] = field(default_factory=dict)
    #: Checks of one's own by name: functions from blocks in context to violations (columns of ``VIOLATIONS``).
    checks: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def __post_init__(self):
        if self.enable and self.disable:
            raise ValueError("--enable and --disable flags must not be set at the same time")
        for name in self.checks:
            if name in VALIDATORS:
                raise ValueError(f"A check named {name} exists")
        for name in (*self.enable, *self.disable):
            if name not in VALIDATORS and name not in self.checks:
                raise ValueError(f"Unknown validator: {name}")
        for k, x in self.extensions.items():
            if x not in EXTENSIONS:
                raise ValueError(f"Unsupported extension mapping: {k}={x}")

    def names(self) -> list[str]:
        return [n for n in (*VALIDATORS, *self.checks) if (n in self.enable if self.enable else n not in self.disable)]


def no_changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHANGES)


def changes_of(diffs: DataFrame) -> DataFrame:
    """Changes of the diffs; ValidationError for a diff that can't be used."""
    found = diff_changes(diffs)
    bad = found.where("error is not null").select(F.min("error")).first()[0]
    if bad:
        raise ValidationError(bad)
    return found.drop("error")


def blocks_in_context(files: DataFrame, changes: DataFrame | None, options: Options, having: list[str] | None = None) -> DataFrame:
    """Blocks of all scanned files, and those that a diff touches in files that only the diff names.

    Files are scanned if a glob matches, or, without any glob, if there is no diff. With
    ``having``, only files with any of these words are parsed.
    """
    path = F.col("path")
    files = files.where(~matches_any(path, options.ignore)) if options.ignore else files
    scan_all = not options.globs and changes is None
    scanned = F.lit(True) if scan_all else matches_any(path, options.globs)
    if changes is None:
        files = files.where(scanned)
        changes = no_changes(files.sparkSession)
    else:
        named = changes.select("path").distinct()
        rest = files.where(~scanned).join(named, "path", "left_semi")
        files = files.where(scanned).unionByName(rest) if options.globs else rest
    marked = mark_modified(extract_blocks(files, options.extensions, having), changes)
    return marked.where(scanned | F.col("error").isNotNull() | F.col("is_content_modified") | F.col("is_start_tag_modified"))


def checked(blocks: DataFrame) -> DataFrame:
    """``blocks`` without the column ``error``, after a pass that raises the first error by path."""
    bad = blocks.where("error is not null").select(F.min_by("error", "path")).first()[0]
    if bad:
        raise ValidationError(bad)
    return blocks.drop("error")


def violations(blocks: DataFrame, options: Options, context: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Union of the selected checks over blocks in context: one pass for all that a block decides alone, and a plan for each other.

    ``context`` gives the blocks of files with a word in them, for checks that need no others.
    """
    names = options.names()
    of = context or (lambda word: blocks)
    local = [n for n in names if n in LOCAL]
    parts = [local_checks(blocks, local)] if local else []
    if "affects" in names:
        parts.append(v.affects(of("affects"), of("name")))
    if "check-lua" in names:
        parts.append(v.check_script(of("check-lua"), options.scripts, of("name")))
    if "check-ai" in names:
        parts.append(v.check_ai(of("check-ai"), options.ai_client or v.ChatClient(), of("name")))
    parts += [check(blocks) for name, check in options.checks.items() if name in names]
    return reduce(DataFrame.unionByName, parts) if parts else local_checks(blocks, [])


def file_violations(files: DataFrame, changes: DataFrame | None, options: Options) -> DataFrame:
    """Violations in files, without keeping their blocks: files are parsed once for what blocks decide alone, and those
    that a reference or a verdict may concern once more. Files whose tags don't pair are passed over.
    """
    of = lambda having: blocks_in_context(files, changes, options, having).where("error is null").drop("error")
    blocks = of(None if options.checks else [n for n in options.names() if n in LOCAL])
    return violations(blocks, options, lambda word: of([word]))


def validate(files: DataFrame, changes: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """Violations of the blocks in ``files``; raises ValidationError where the run can't go on.

    Blocks are parsed once and kept in memory or on disk while the checks read them.
    """
    options = options or Options()
    blocks = blocks_in_context(files, changes, options).persist()
    found = violations(checked(blocks), options).persist()
    bad = found.where("error is not null").select(F.min_by("error", F.struct("path", "code", "error"))).first()[0]
    if bad:
        raise ValidationError(bad)
    return found.drop("error")


def list_blocks(files: DataFrame, changes: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """path, name, line, column, is_content_modified, attributes of the blocks in context."""
    rows = checked(blocks_in_context(files, changes, options or Options()))
    name = F.coalesce(F.try_element_at("attrs", F.lit("name")), F.lit(UNNAMED))
    return rows.select("path", name.alias("name"), F.col("tag_start.line").alias("line"), F.col("tag_start.character").alias("column"), "is_content_modified", F.col("attrs").alias("attributes"))


def has_errors(found: DataFrame) -> bool:
    return not found.where("severity = 1").isEmpty()


def report_by_path(found: DataFrame) -> DataFrame:
    """path, diagnostics: per path a JSON array of its violations, by position and code."""
    entry = F.struct("range", "code", "message", "severity", "data")
    rows = found.withColumn("range", F.struct("start", "end"))
    return rows.groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("all")).select("path", F.to_json("all").alias("diagnostics"))


def report(found: DataFrame) -> str:
    """The pretty JSON report of violations; empty if there are none."""
    out: dict[str, list] = {}
    for r in report_by_path(found).orderBy("path").toLocalIterator():
        out[r.path] = [{**d, "data": json.loads(d["data"])} if "data" in d else d for d in json.loads(r.diagnostics)]
    return json.dumps(out, indent=2, ensure_ascii=False) if out else ""


def listing(rows: DataFrame) -> str:
    """The pretty JSON listing of blocks, by path and line."""
    entry = F.struct("line", "column", "name", "is_content_modified", "attributes")
    got = rows.withColumn("attributes", F.to_json("attributes")).groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("all")).orderBy("path")
    out = {r.path: [{"name": e.name, "line": e.line, "column": e.column, "is_content_modified": e.is_content_modified, "attributes": json.loads(e.attributes)} for e in r.all] for r in got.toLocalIterator()}
    return json.dumps(out, indent=2, ensure_ascii=False)
