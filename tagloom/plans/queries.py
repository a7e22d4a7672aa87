"""The engine's operators as queries over the tables, with SQL that computes the same from the rows.

Rows become annotated files, the whole pipeline (format, comments, tags, blocks, checks)
runs over these, and the SQL gets the same answers without any file or tag.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import matches_any
from ..operators import validators as v
from ..operators.changes import diff_changes, mark_modified
from ..operators.extract import extract_blocks, extract_comments, format_of, spread
from ..operators.local import local_file_checks
from .engine import Options, file_violations, list_blocks, report_by_path


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


def _files(rows: DataFrame, path: Column, attrs: Column | str, body: Column) -> DataFrame:
    """One Python file per row with one block: the tag on line 1, the body from line 2."""
    attrs = F.lit(attrs) if isinstance(attrs, str) else attrs
    text = F.concat(F.lit("# <block "), attrs, F.lit(">\n"), body, F.lit("\n# </block>\n"))
    return spread(rows).select(path.cast("string").alias("path"), text.alias("content"))


def _blocks(files: DataFrame, having: list[str] | None = None) -> DataFrame:
    return extract_blocks(files, having=having).where("error is null").withColumn("is_content_modified", F.lit(True))


def _path(prefix: str, *cols: str) -> Column:
    parts = [F.lit(prefix + "/")]
    for c in cols:
        parts += [F.col(c).cast("string"), F.lit("_")]
    return F.concat(*parts[:-1], F.lit(".py"))


def _id(n: int = 0) -> Column:
    name = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    return F.get(F.split(name, "_"), F.lit(n)).cast("bigint")


def _docs(s: SparkSession, d: str, attrs: str) -> DataFrame:
    return _files(_t(s, d, "documents"), _path("docs", "doc_id"), attrs, F.col("text"))


def _found(rows: DataFrame, *ids: Column) -> DataFrame:
    return rows.select(*ids, F.col("start.line").alias("line"), F.col("start.character").alias("first_col"), F.col("end.character").alias("last_col"))


def _joined(rows: DataFrame, keys: list[str], order: list[str], line: Column) -> DataFrame:
    """Rows of a group as the lines of one text, in order."""
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line__")))).alias("all"))
    return got.select(*keys, F.array_join(F.transform("all", lambda x: x["line__"]), "\n").alias("body"))


def _comments_html(s, d):
    files = spread(_t(s, d, "pages")).select(F.concat(F.lit("p/"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return extract_comments(files).select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("page_id"), F.col("seq").cast("bigint").alias("seq"), "text")


def _blocks_list(s, d):
    rows = _t(s, d, "customer").withColumn("part", F.floor(F.col("c_custkey") / 500))
    segs = _joined(rows, ["c_nationkey", "part", "c_mktsegment"], ["c_custkey"], F.col("c_name"))
    block = F.concat(F.lit('  # <block name="'), F.col("c_mktsegment"), F.lit('">\n'), F.col("body"), F.lit("\n# </block>"))
    files = _joined(segs.withColumn("block", block), ["c_nationkey", "part"], ["c_mktsegment"], F.col("block"))
    files = files.select(_path("n", "c_nationkey", "part").alias("path"), F.col("body").alias("content"))
    return list_blocks(files).select(_id(0).alias("nation"), _id(1).alias("part"), F.col("name").alias("segment"), "line", "column")


def _line_count(s, d):
    rows = local_file_checks(_docs(s, d, 'line-count="<=8"'), ["line-count"])
    return rows.select(_id().alias("doc_id"), F.get_json_object("data", "$.actual").cast("bigint").alias("actual"), "message")


def _sorted_desc(s, d):
    body = _joined(_t(s, d, "orders"), ["o_custkey"], ["o_orderkey"], F.col("o_orderpriority"))
    return _found(local_file_checks(_files(body, _path("o", "o_custkey"), 'keep-sorted="desc"', F.col("body")), ["keep-sorted"]), _id().alias("custkey"))


def _sorted_numeric(s, d):
    body = _joined(_t(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_quantity"], F.col("l_quantity").cast("bigint").cast("string"))
    return _found(local_file_checks(_files(body, _path("l", "l_orderkey"), 'keep-sorted-format="numeric" keep-sorted', F.col("body")), ["keep-sorted"]), _id().alias("orderkey"))


def _sorted_pattern(s, d):
    line = F.concat(F.lit("  no: "), F.col("p_size"), F.lit(" "), F.col("p_brand"))
    body = _joined(_t(s, d, "part").withColumn("bin", F.floor(F.col("p_partkey") / 20)), ["bin"], ["p_partkey"], line)
    attrs = 'keep-sorted-pattern="no: (?P<value>[0-9]+)" keep-sorted-format="numeric" keep-sorted="asc"'
    return _found(local_file_checks(_files(body, _path("p", "bin"), attrs, F.col("body")), ["keep-sorted"]), _id().alias("bin"))


def _unique_pattern(s, d):
    body = _joined(_t(s, d, "events"), ["user_id"], ["event_id"], F.concat(F.col("event_type"), F.lit(" = "), F.col("event_id")))
    return _found(local_file_checks(_files(body, _path("e", "user_id"), 'keep-unique="^[a-z_]+"', F.col("body")), ["keep-unique"]), _id().alias("user_id"))


def _supplier_files(s, d) -> DataFrame:
    """A block per supplier that refers to its nation's and to its own; nations' blocks are modified if their key is even."""
    sup = _t(s, d, "supplier").select(_path("s", "s_suppkey").alias("path"), F.concat(F.lit('# <block name="me" affects="n/'), F.col("s_nationkey"), F.lit('.py:nation, :me, :gone">\n'), F.col("s_name"), F.lit("\n# </block>\n")).alias("content"))
    nat = _t(s, d, "nation").select(_path("n", "n_nationkey").alias("path"), F.concat(F.lit('# <block name="nation">\n'), F.col("n_name"), F.lit("\n# </block>\n")).alias("content"))
    return sup.unionByName(nat)


def _supplier_blocks(s, d) -> DataFrame:
    return extract_blocks(_supplier_files(s, d)).withColumn("is_content_modified", F.col("path").startswith("s/") | (_id() % 2 == 0))


def _affects(s, d):
    rows = v.affects(_supplier_blocks(s, d))
    return rows.select(_id().alias("suppkey"), F.get_json_object("data", "$.affected_block_file_path").alias("file"), F.get_json_object("data", "$.affected_block_name").alias("name"))


def _lookup(s, d):
    return v.affected_blocks(_supplier_blocks(s, d)).select(_id().alias("suppkey"), F.posexplode("affected").alias("ord", "a")).select("suppkey", F.col("ord").cast("bigint").alias("ord"), F.col("a.file").alias("file"), F.col("a.content").alias("content"))


def _order_blocks(s, d) -> DataFrame:
    """A block per order with a line for each item."""
    body = _joined(_t(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], F.col("l_partkey").cast("string"))
    return extract_blocks(_files(body, _path("l", "l_orderkey"), "name=x", F.col("body")))


def _overlap(s, d):
    changes = _t(s, d, "lineitem").select(_path("l", "l_orderkey").alias("path"), (F.col("l_suppkey") % 12 + 1).alias("line"), F.lit(None).cast("array<struct<s: int, e: int>>").alias("ranges"))
    rows = mark_modified(_order_blocks(s, d), changes).where("is_content_modified or is_start_tag_modified")
    return rows.select(_id().alias("orderkey"), "is_content_modified", "is_start_tag_modified")


def _patches(s, d) -> DataFrame:
    """A diff per part: a context line, then two lines more, or a line less if its size is odd."""
    k, n = F.col("p_partkey").cast("string"), (F.col("p_size") + 1).cast("string")
    head = F.concat(F.lit("--- a/p/"), k, F.lit(".py\n+++ b/p/"), k, F.lit(".py\n"))
    more = F.concat(F.lit("@@ -"), n, F.lit(",1 +"), n, F.lit(",3 @@\n x\n+"), F.col("p_name"), F.lit("\n+z\n"))
    less = F.concat(F.lit("@@ -"), n, F.lit(",3 +"), n, F.lit(",2 @@\n x\n-"), F.col("p_name"), F.lit("\n y\n"))
    return _t(s, d, "part").select(F.concat(head, F.when(F.col("p_size") % 2 == 0, more).otherwise(less)).alias("text"))


def _diff_changes(s, d):
    return diff_changes(_patches(s, d)).where("error is null").select(_id().alias("partkey"), "line", F.col("ranges").isNull().alias("whole_line"))


def _diff_similarity(s, d):
    # a shuffle of a stated number of partitions serves the join and isn't made smaller: comparing texts costs far more than moving them
    parts = max(s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")))
    a, b = (_t(s, d, "conversations").select("conv_id", (F.col("turn") + k).alias("turn"), F.regexp_replace("text", r"[\r\n]+", " ").alias(n)).repartition(parts, "conv_id", "turn") for k, n in ((1, "old"), (0, "new")))
    head = F.concat(F.lit("--- a/c\n+++ b/"), F.concat_ws("_", "conv_id", "turn"), F.lit(".py\n@@ -1,1 +1,1 @@\n-"))
    diffs = a.join(b, ["conv_id", "turn"]).select(F.concat(head, F.col("old"), F.lit("\n+"), F.col("new"), F.lit("\n")).alias("text"))
    return diff_changes(diffs).where("error is null").select(_id(0).alias("conv_id"), _id(1).alias("turn"), "line", F.size("ranges").cast("bigint").alias("n_ranges"))


def _diff_edits(s, d):
    """Each part's name against itself with one character changed, put in or taken out."""
    name, n = F.col("p_name"), F.col("p_partkey") % F.length("p_name") + 1
    head, tail = F.substring(name, F.lit(1), (n - 1).cast("int")), F.substring(name, (n + 1).cast("int"), F.length(name))
    new = F.when(F.col("p_partkey") % 3 == 0, F.concat(head, F.lit("#"), tail)).when(F.col("p_partkey") % 3 == 1, F.concat(head, F.lit("#"), F.substring(name, n.cast("int"), F.length(name)))).otherwise(F.concat(head, tail))
    rows = _t(s, d, "part").select("p_partkey", name.alias("old"), new.alias("new"))
    diffs = rows.select(F.concat(F.lit("--- a/c\n+++ b/"), F.col("p_partkey"), F.lit(".py\n@@ -1,1 +1,1 @@\n-"), F.col("old"), F.lit("\n+"), F.col("new"), F.lit("\n")).alias("text"))
    got = diff_changes(diffs).where("error is null and size(ranges) = 1")
    return got.select(_id().alias("partkey"), "line", (F.col("ranges")[0]["e"] - F.col("ranges")[0]["s"]).cast("bigint").alias("width"), F.when(_id() % 3 < 2, F.col("ranges")[0]["s"]).cast("bigint").alias("at"))


def _path_scope(s, d):
    rows = _t(s, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/x."), F.element_at(F.array(*map(F.lit, ("py", "d.ts", "txt", "html"))), (F.col("page_id") % 4 + 1).cast("int"))).alias("path"))
    rows = rows.where(matches_any(F.col("path"), ["**/*.ts", "*.py", "*.txt"]) & ~matches_any(F.col("path"), ["*7*"]))
    return rows.select("page_id", format_of(F.col("path")).alias("format")).where("format is not null")


def _priced_orders(s, d) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, ("Error", "warning", "INFO", "hint"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _files(_t(s, d, "orders"), _path("o", "o_orderkey"), F.concat(F.lit('line-count=">=2" severity="'), severity, F.lit('"')), F.when(F.col("o_totalprice") > 200000, F.lit("a\n\nb")).otherwise(F.lit("a")))


def _severity(s, d):
    return local_file_checks(_priced_orders(s, d), ["line-count"]).groupBy("severity").agg(F.count("*").alias("n"), F.min("message").alias("least")).select(F.col("severity").cast("int").alias("severity"), "n", "least")


def _report(s, d):
    both = local_file_checks(_docs(s, d, 'line-count="<=8" keep-sorted'), ["line-count", "keep-sorted"])
    return report_by_path(both).select(_id().alias("doc_id"), F.size(F.from_json("diagnostics", "array<struct<code: string>>")).cast("bigint").alias("n"))


def _all_checks(s, d):
    files = _docs(s, d, 'line-count="<=8" keep-sorted keep-unique line-pattern="^[A-Za-z]"')
    found = file_violations(files, None, Options(disable=["check-ai", "check-lua"]))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.sum("start.line").alias("lines"))


def _ai(s, d):
    client = lambda condition, content: "OK." if condition in content else "no " + condition
    files = _docs(s, d, 'check-ai="the"')
    rows = v.check_ai(_blocks(files), client, _blocks(files, ["affects"]))
    return rows.select(_id().alias("doc_id"), F.get_json_object("data", "$.ai_message").alias("said"))


def _script(s, d):
    files = _docs(s, d, 'check-lua="short" check-lua-pattern="[A-Z]+"')
    rows = v.check_script(_blocks(files), {"short": lambda ctx, c: c if len(c) > 3 else None}, _blocks(files, ["affects"]))
    return rows.select(_id().alias("doc_id"), F.get_json_object("data", "$.lua_error").alias("said"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "comments_html": _comments_html,
        "blocks_list": _blocks_list,
        "line_count": _line_count,
        "keep_sorted_lex": lambda s, d: _found(local_file_checks(_docs(s, d, "keep-sorted"), ["keep-sorted"]), _id().alias("doc_id")),
        "keep_sorted_desc": _sorted_desc,
        "keep_sorted_numeric": _sorted_numeric,
        "keep_sorted_pattern": _sorted_pattern,
        "keep_unique": lambda s, d: _found(local_file_checks(_docs(s, d, "keep-unique"), ["keep-unique"]), _id().alias("doc_id")),
        "keep_unique_pattern": _unique_pattern,
        "line_pattern": lambda s, d: _found(local_file_checks(_docs(s, d, 'line-pattern="^[A-Z]"'), ["line-pattern"]), _id().alias("doc_id")),
        "affects_drift": _affects,
        "affects_lookup": _lookup,
        "overlap_modified": _overlap,
        "diff_changes": _diff_changes,
        "diff_similarity": _diff_similarity,
        "diff_edits": _diff_edits,
        "path_scope": _path_scope,
        "severity_report": _severity,
        "report_by_path": _report,
        "union_all_validators": _all_checks,
        "check_ai": _ai,
        "check_script": _script,
    }


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINES = f"""
with raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
v as (select doc_id, k, {_TRIM.format("line")} as v, strlen(line) - strlen(regexp_replace(line, '^\\s+', '')) as lead from raw),
b as (select * from v where v <> '')"""
_FIRST = "select {id}, min(k) + 1 as line, arg_min(lead, k) + 1 as first_col, arg_min(lead + strlen(v), k) as last_col from {rel} group by {id}"


def _lag(rel: str, key: str, order: str, compare: str) -> str:
    return f"select *, {compare} as bad from (select *, lag(v) over (partition by {key} order by {order}) as p from {rel}) where p is not null"


def oracle_sql() -> dict[str, str]:
    unsorted = f"x as ({_lag('b', 'doc_id', 'k', 'p > v')})"
    repeated = "y as (select * from (select *, row_number() over (partition by doc_id, v order by k) as n from b) where n > 1)"
    return {
        "comments_html": r"""
            with c as (select page_id, regexp_extract_all(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g'), '(?s)<!--.*?-->') as l from pages)
            select page_id, generate_subscripts(l, 1) - 1 as seq, '    ' || substr(unnest(l), 5, length(unnest(l)) - 7) || '   ' as text from c""",
        "blocks_list": """
            with g as (select c_nationkey, c_custkey // 500 as part, c_mktsegment, count(*) as n from customer group by all)
            select c_nationkey::bigint as nation, part::bigint as part, c_mktsegment as segment,
                   (1 + coalesce(sum(n + 2) over (partition by c_nationkey, part order by c_mktsegment rows between unbounded preceding and 1 preceding), 0))::bigint as line, 5::bigint as "column" from g""",
        "line_count": _LINES + """
            select d.doc_id, coalesce(n, 0)::bigint as actual, 'Block docs/' || d.doc_id || '.py:(unnamed) defined at line 1 has ' || coalesce(n, 0) || ' lines, which does not satisfy <=8' as message
            from documents d left join (select doc_id, count(*) as n from b group by doc_id) c using (doc_id) where coalesce(n, 0) > 8""",
        "keep_sorted_lex": _LINES + f", {unsorted} " + _FIRST.format(id="doc_id", rel="x where bad"),
        "keep_sorted_desc": f"""
            with b as (select o_custkey as custkey, row_number() over (partition by o_custkey order by o_orderkey) as k, o_orderpriority as v, 0 as lead from orders),
            x as ({_lag("b", "custkey", "k", "p < v")}) """ + _FIRST.format(id="custkey", rel="x where bad"),
        "keep_sorted_numeric": f"""
            with b as (select l_orderkey as orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as k, l_quantity::bigint as v, 0 as lead from lineitem),
            x as ({_lag("b", "orderkey", "k", "p > v")}), z as (select orderkey, k, v::varchar as v, lead from x where bad) """ + _FIRST.format(id="orderkey", rel="z"),
        "keep_sorted_pattern": f"""
            with b as (select p_partkey // 20 as bin, row_number() over (partition by p_partkey // 20 order by p_partkey) as k, p_size as v, 6 as lead from part),
            x as ({_lag("b", "bin", "k", "p > v")}), z as (select bin, k, v::varchar as v, lead from x where bad) """ + _FIRST.format(id="bin", rel="z"),
        "keep_unique": _LINES + f", {repeated} " + _FIRST.format(id="doc_id", rel="y"),
        "keep_unique_pattern": """
            with b as (select user_id, row_number() over (partition by user_id order by event_id) as k, event_type as v, 0 as lead from events),
            y as (select * from (select *, row_number() over (partition by user_id, v order by k) as n from b) where n > 1) """ + _FIRST.format(id="user_id", rel="y"),
        "line_pattern": _LINES + ", w as (select * from b where not regexp_matches(v, '^[A-Z]')) " + _FIRST.format(id="doc_id", rel="w"),
        "affects_drift": """
            select s_suppkey as suppkey, 'n/' || s_nationkey || '.py' as file, 'nation' as name from supplier where s_nationkey % 2 = 1
            union all select s_suppkey, 's/' || s_suppkey || '.py', 'gone' from supplier""",
        "affects_lookup": """
            select s_suppkey as suppkey, 0::bigint as ord, 'n/' || s_nationkey || '.py' as file, n_name as content from supplier join nation on n_nationkey = s_nationkey
            union all select s_suppkey, 1, 's/' || s_suppkey || '.py', s_name from supplier""",
        "overlap_modified": """
            with n as (select l_orderkey, count(*) as n from lineitem group by 1), c as (select l_orderkey, l_suppkey % 12 + 1 as line from lineitem)
            select l_orderkey as orderkey, bool_or(line between 1 and n + 2) as is_content_modified, bool_or(line = 1) as is_start_tag_modified
            from n join c using (l_orderkey) group by 1 having bool_or(line between 1 and n + 2)""",
        "diff_changes": """
            select p_partkey as partkey, (p_size + 1 + k)::bigint as line, true as whole_line from part, (values (1), (2)) t(k) where p_size % 2 = 0 or k = 1""",
        "diff_edits": """
            select p_partkey as partkey, 1::bigint as line, 1::bigint as width, case when p_partkey % 3 < 2 then p_partkey % length(p_name) end::bigint as "at" from part""",
        "path_scope": r"""
            with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') || '/x.' || (['py', 'd.ts', 'txt', 'html'])[page_id % 4 + 1] as path from pages)
            select page_id, case when path like '%.py' then 'python' else 'typescript' end as format from p where (path like '%.ts' or path like '%.py') and path not like '%7%'""",
        "severity_report": """
            select (o_orderkey % 4 + 1)::int as severity, count(*) as n,
                   min('Block o/' || o_orderkey || '.py:(unnamed) defined at line 1 has 1 lines, which does not satisfy >=2') as least from orders where o_totalprice <= 200000 group by 1""",
        "report_by_path": _LINES + f""", {unsorted}
            select doc_id, count(*) as n from (select doc_id from b group by doc_id having count(*) > 8 union all select distinct doc_id from x where bad) group by doc_id""",
        "union_all_validators": _LINES + f""", {unsorted}, {repeated}, w as (select * from b where not regexp_matches(v, '^[A-Za-z]')),
            f as (select 'line-count' as code, 1 as line from b group by doc_id having count(*) > 8 union all select 'keep-sorted', min(k) + 1 from x where bad group by doc_id
                  union all select 'keep-unique', min(k) + 1 from y group by doc_id union all select 'line-pattern', min(k) + 1 from w group by doc_id)
            select code, count(*) as n, sum(line)::bigint as lines from f group by code""",
        "check_ai": "select doc_id, 'no the' as said from documents where not contains(text, 'the')",
        "check_script": "select doc_id, regexp_extract(text, '[A-Z]+') as said from documents where length(regexp_extract(text, '[A-Z]+')) > 3",
    }
