"""The checks, each a function from blocks in context to a table of violations.

Those that a block decides alone are one pass of their own; references between blocks are a
hash anti-join; a model's or a script's verdict is asked for in Arrow batches.

What makes a whole run fail (a bad pattern, a bad option) is a row with ``error`` set.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import linear
from ..functions.text import PY_SPACES, trimmed
from .local import SEVERITIES, local_checks
from .schemas import UNNAMED

_KEY = ["path", "ordinal"]
_BASE = [*_KEY, "attrs", "tag_start", "tag_end", "content", "is_content_modified"]


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _where() -> Column:
    return F.concat(F.col("path"), F.lit(":"), F.coalesce(attr("name"), F.lit(UNNAMED)))


def _line() -> Column:
    return F.col("tag_start.line").cast("string")


def _block_at(*rest: Any) -> Column:
    return F.concat(F.lit("Block "), _where(), F.lit(" defined at line "), _line(), *rest)


def _at(*rest: Any) -> Column:
    return F.concat(*rest, F.lit(" in "), _where(), F.lit(" at line "), _line())


def _with(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.where(F.map_contains_key("attrs", F.lit(name))).select(*_BASE)


def _severity() -> Column:
    raw = attr("severity")
    table = F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv))
    return F.when(raw.isNull(), F.lit(1)).otherwise(F.try_element_at(table, F.lower(raw)))


def _report(rows: DataFrame, code: str, message: Column, data: Column | None, start: Column, end: Column) -> DataFrame:
    """Violations of ``rows``; a severity that can't be read is an error, but only on a violation."""
    fatal = F.coalesce(F.col("fatal"), F.when(_severity().isNull(), F.lit('Failed to parse "severity" attribute')))
    keep = lambda c: F.when(fatal.isNull(), c)
    return rows.select(
        "path", keep(start).alias("start"), keep(end).alias("end"), F.lit(code).alias("code"), keep(message).alias("message"),
        keep(_severity()).cast("tinyint").alias("severity"), keep(F.lit(None).cast("string") if data is None else data).alias("data"), fatal.alias("error"),
    )


def keep_sorted(blocks: DataFrame) -> DataFrame:
    """First line of a block that isn't in order after the last comparable one before it."""
    return local_checks(blocks, ["keep-sorted"])


def keep_unique(blocks: DataFrame) -> DataFrame:
    """First line of a block whose value an earlier line has."""
    return local_checks(blocks, ["keep-unique"])


def line_pattern(blocks: DataFrame) -> DataFrame:
    """First non-blank line of a block in which the pattern isn't found."""
    return local_checks(blocks, ["line-pattern"])


def line_count(blocks: DataFrame) -> DataFrame:
    """Blocks whose number of non-blank lines doesn't satisfy the comparison."""
    return local_checks(blocks, ["line-count"])


def references(blocks: DataFrame) -> DataFrame:
    """``blocks`` with affects, once per reference: ord, ref_file, ref_name; fatal where one can't be read."""
    rows = _with(blocks, "affects").select("*", F.posexplode(F.split(attr("affects"), ",")).alias("ord", "raw"))
    ref = trimmed(F.col("raw"))
    parts = F.split(ref, ":", 2)
    file = trimmed(F.get(parts, F.lit(0)))
    bad = F.concat(F.lit('Invalid "affects" attribute value: "'), ref, F.lit('"'))
    return rows.withColumn("fatal", F.when(~ref.contains(":"), bad)).withColumn("ref_file", F.when(file == "", F.col("path")).otherwise(file)).withColumn("ref_name", trimmed(F.get(parts, F.lit(1)))).drop("raw")


def affects(blocks: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """References of modified blocks to blocks that aren't modified; ``named`` has the blocks that may be referred to, if they aren't ``blocks``."""
    named = (blocks if named is None else named).where("is_content_modified")
    named = named.select(F.col("path").alias("ref_file"), attr("name").alias("ref_name")).where("ref_name is not null").distinct()
    rows = references(blocks.where("is_content_modified"))
    loose = rows.where("fatal is null").join(named, ["ref_file", "ref_name"], "left_anti").unionByName(rows.where("fatal is not null"))
    message = F.concat(F.lit("Block "), _where(), F.lit(" at line "), _line(), F.lit(" is modified, but "), F.col("ref_file"), F.lit(":"), F.col("ref_name"), F.lit(" is not"))
    data = F.to_json(F.struct(F.col("ref_file").alias("affected_block_file_path"), F.col("ref_name").alias("affected_block_name")))
    return _report(loose, "affects", message, data, F.col("tag_start"), F.col("tag_end"))


def affected_blocks(blocks: DataFrame) -> DataFrame:
    """path, ordinal, affected: the blocks that a block's references lead to, in order of reference, then of position."""
    target = blocks.select(F.col("path").alias("ref_file"), attr("name").alias("ref_name"), F.col("ordinal").alias("n"), trimmed(F.col("content")).alias("text")).where("ref_name is not null")
    found = references(blocks).where("fatal is null").join(target, ["ref_file", "ref_name"])
    entry = F.struct("ord", "n", F.col("ref_file").alias("file"), F.col("ref_name").alias("name"), F.col("text").alias("content"))
    rows = found.groupBy(*_KEY).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    return rows.select(*_KEY, F.transform("all", lambda e: F.struct(e["file"].alias("file"), e["name"].alias("name"), e["content"].alias("content"))).alias("affected"))


Checker = Callable[[dict[str, Any], str], "str | None"]


def _selected(text: str, pattern: str | None, option: str) -> str:
    """What a check sees: the pattern's first match in the content, else the trimmed content."""
    if pattern is None:
        return text.strip(PY_SPACES)
    compiled = linear(pattern)
    if isinstance(compiled, str):
        raise ValueError(f"{option}-pattern is not a valid regex: {compiled}")
    return compiled.selected(text)


def _run_checks(rows: DataFrame, option: str, check: Checker, empty: str, failed: str) -> DataFrame:
    """``rows`` with verdict and fatal from a callable, called in Python for each block whose option isn't blank."""

    def run(batches):
        for pdf in batches:
            verdicts, failures = [], []
            for r in pdf.itertuples():
                attrs = dict(r.attrs)
                at = f" in {r.path}:{attrs.get('name', UNNAMED)} at line {r.tag_line}"
                ctx = {"file": r.path, "line": r.tag_line, "attrs": attrs}
                if "affects" in attrs:
                    ctx["affects"] = [] if r.affected is None else [e.asDict() if hasattr(e, "asDict") else dict(e) for e in r.affected]
                verdict = failure = None
                if not attrs[option].strip(PY_SPACES):
                    failure = empty + at
                else:
                    try:
                        verdict = check(ctx, _selected(r.content, attrs.get(f"{option}-pattern"), option))
                        if verdict is not None and not isinstance(verdict, str):
                            raise TypeError(f"validate() must return nil or a string, got: {type(verdict).__name__}")
                    except Exception as e:  # whatever a user's check raises ends the run with its message
                        verdict, failure = None, f"{failed}{at}: {type(e).__name__}: {e}"
                verdicts.append(verdict)
                failures.append(failure)
            yield pdf.drop(columns=["tag_line"]).assign(verdict=verdicts, fatal=failures)

    schema = T.StructType([*rows.schema.fields, T.StructField("verdict", T.StringType()), T.StructField("fatal", T.StringType())])
    return rows.withColumn("tag_line", F.col("tag_start.line")).mapInPandas(run, schema)


def _external(blocks: DataFrame, option: str, label: str, check: Checker, empty: str, failed: str, data: Callable[[], Column], context: DataFrame | None) -> DataFrame:
    rows = _with(blocks, option).join(affected_blocks(blocks if context is None else context), _KEY, "left")
    out = _run_checks(rows, option, check, empty, failed).where("fatal is not null or verdict is not null")
    message = _block_at(F.lit(f" failed {label} check: "), F.col("verdict"))
    return _report(out, option, message, data(), F.col("tag_start"), F.col("tag_end"))


def check_ai(blocks: DataFrame, client: Callable[[str, str], str], context: DataFrame | None = None) -> DataFrame:
    """Blocks that a model finds in breach of the condition in ``check-ai``; ``client`` takes condition and content.

    ``context`` has the blocks that references lead from and to, if they aren't ``blocks``.
    """

    def check(ctx: dict, content: str) -> str | None:
        answer = client(ctx["attrs"]["check-ai"], content)
        if answer is None or answer == "":
            raise ValueError("empty answer")
        return None if answer.strip().lower() in ("ok", "ok.") else answer

    data = lambda: F.to_json(F.struct(attr("check-ai").alias("condition"), F.col("verdict").alias("ai_message")))
    return _external(blocks, "check-ai", "AI", check, "check-ai requires a non-empty condition", "check-ai API error", data, context)


def check_script(blocks: DataFrame, scripts: dict[str, Checker], context: DataFrame | None = None) -> DataFrame:
    """Blocks that a registered callable rejects; ``check-lua`` names the callable, as it would a script's path."""

    def check(ctx: dict, content: str) -> str | None:
        name = ctx["attrs"]["check-lua"]
        if name not in scripts:
            raise LookupError(f"no check is registered as {name!r}")
        return scripts[name](ctx, content)

    data = lambda: F.to_json(F.struct(attr("check-lua").alias("script"), F.col("verdict").alias("lua_error")))
    return _external(blocks, "check-lua", "Lua", check, "check-lua requires a non-empty script path", "check-lua script error", data, context)


class ChatClient:
    """A client of a chat-completions endpoint, configured by arguments or by the environment."""

    def __init__(self, api_key: str | None = None, url: str | None = None, model: str | None = None, timeout: float = 60):
        self.key = api_key if api_key is not None else os.environ.get("TAGLOOM_AI_API_KEY", "")
        self.url = url or os.environ.get("TAGLOOM_AI_API_URL", "https://api.openai.com/v1")
        self.model = model or os.environ.get("TAGLOOM_AI_MODEL", "gpt-5-nano")
        self.timeout = timeout

    def __call__(self, condition: str, content: str) -> str:
        if not self.key:
            raise ValueError("the API key is empty")
        asked = f"What must hold:\n{condition}\n\nThe text, as it stands in the file:\n{content}"
        rules = "Judge whether the text meets the condition. Answer OK if it does, else say briefly what is wrong."
        body = {"model": self.model, "messages": [{"role": "system", "content": rules}, {"role": "user", "content": asked}]}
        request = urllib.request.Request(self.url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]
