"""Checks, plans, reports, sources and the command line."""

import io
import json
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom import cli
from tagloom.functions.patterns import Linear, PatternError, linear
from tagloom.functions.text import glob_regex, trimmed
from tagloom.operators import validators as v
from tagloom.operators.changes import mark_modified
from tagloom.operators.extract import extract_blocks, extract_comments, format_of
from tagloom.plans import queries
from tagloom.plans.engine import VALIDATORS, Options, ValidationError, changes_of, file_violations, has_errors, list_blocks, listing, report, validate
from tagloom.sources.repo import contained, diff_text, find_root, in_memory, read_diff, read_repo, walk
from tagloom.streaming.diffs import validate_stream

SF = "/root/testdata/sf0.001"


def run(spark, content, path="a.py", **options):
    """The report of one file, by the checks that it asks for."""
    options.setdefault("enable", [n for n in VALIDATORS if f"{n}=" in content or f"{n} " in content or f"{n}>" in content] or ["line-count"])
    return json.loads(report(validate(in_memory(spark, {path: content}), None, Options(**options))) or "{}").get(path, [])


def span(d):
    r = d["range"]
    return (r["start"]["line"], r["start"]["character"], r["end"]["line"], r["end"]["character"])


def block(attrs, *body):
    return f"# <block {attrs}>\n" + "\n".join(body) + "\n# </block>\n"


@pytest.mark.parametrize(
    "attrs,body,expected",
    [
        ("keep-sorted", ["a", "  c", "\tb "], (4, 2, 4, 2)), ("keep-sorted", ["a", "", "b"], None), ('keep-sorted="DESC"', ["c", "b", "bb"], (4, 1, 4, 2)), ('keep-sorted="desc"', ["b", "b"], None),
        ('keep-sorted keep-sorted-format="numeric"', ["2", "10", "9.5"], (4, 1, 4, 3)), ('keep-sorted keep-sorted-format=" Numeric "', ["-inf", "-0", "0", "1e3", "nan"], None),
        ('keep-sorted keep-sorted-format="numeric"', ["0", "-0.0"], (3, 1, 3, 4)), ('keep-sorted keep-sorted-pattern="no: (?P<value>[0-9]+)"', ["no: 3", "x", "é no: 10"], (4, 8, 4, 9)),
        ('keep-sorted keep-sorted-pattern="[A-Z]+"', ["aB", "A"], (3, 1, 3, 1)), ('keep-sorted keep-sorted-pattern="no: (?P<value>[0-9]+)" keep-sorted-format="numeric"', ["no: 3", "no: 10"], None),
    ],
)
def test_keep_sorted(spark, attrs, body, expected):
    got = run(spark, block(attrs, *body), enable=["keep-sorted"])
    assert [span(d) for d in got] == ([expected] if expected else [])
    if got:
        order = "desc" if "desc" in attrs.lower() else "asc"
        assert got[0]["data"] == {"order_by": order}
        assert got[0]["message"] == "Block a.py:(unnamed) " + f"defined at line 1 has an out-of-order line {expected[0]} ({order})"


@pytest.mark.parametrize(
    "attrs,body,expected",
    [("keep-unique", ["a", " b", "  a"], (4, 3, 4, 3)), ("keep-unique", ["a", "", "", "A"], None), ('keep-unique="^id: (?P<value>\\d+)"', ["id: 1 x", "y", "id: 1 z"], (4, 5, 4, 5)), ('keep-unique="[a-z]"', ["1", "1"], None)],
)
def test_keep_unique(spark, attrs, body, expected):
    got = run(spark, block(attrs, *body), enable=["keep-unique"])
    assert [span(d) for d in got] == ([expected] if expected else [])
    assert not got or "data" not in got[0] and got[0]["message"].endswith(f"has a duplicated line {expected[0]}")


@pytest.mark.parametrize("attrs,body,expected", [('line-pattern="[A-Z]+"', ["xAy", "", "  b "], (4, 3, 4, 3)), ('line-pattern="^a$"', ["a", "a "], None)])
def test_line_pattern(spark, attrs, body, expected):
    got = run(spark, block(attrs, *body), enable=["line-pattern"])
    assert [span(d) for d in got] == ([expected] if expected else [])
    assert not got or got[0]["message"].endswith("has a non-matching line 4 (pattern: /[A-Z]+/)") and got[0]["data"] == {"pattern": "[A-Z]+"}


@pytest.mark.parametrize("expr,bad", [("<3", True), ("<=3", False), ("==3", False), (" >= +3 ", False), (">3", True)])
def test_line_count(spark, expr, bad):
    got = run(spark, block(f'line-count="{expr}"', "a", "", "b", " ", "c"), enable=["line-count"])
    assert bool(got) == bad
    if got:
        assert span(got[0]) == (1, 3, 1, 25) and got[0]["data"] == {"actual": 3, "op": expr[0], "expected": 3}


def test_severities(spark):
    src = "".join(block(f'line-count="==0" severity="{s}"', "x") for s in ("Error", "warning", "INFO", "hint"))
    assert [d["severity"] for d in run(spark, src, enable=["line-count"])] == [1, 2, 3, 4]
    quiet = validate(in_memory(spark, {"a.py": block('line-count="==0" severity=hint', "x")}), None, Options(enable=["line-count"]))
    assert not has_errors(quiet) and quiet.count() == 1
    assert run(spark, block('line-count="==1" severity="loud"', "x"), enable=["line-count"]) == []


@pytest.mark.parametrize(
    "src,message",
    [
        (block('line-count="==0" severity="loud"', "x"), 'Failed to parse "severity" attribute'), (block('line-count="3"', "x"), "error: missing comparator"), (block('line-count="<"', "x"), "error: missing number"),
        (block('line-count="<-1"', "x"), "error: invalid number"), (block('keep-sorted=" asc "', "x"), 'got " asc " in a.py:\\(unnamed\\) at line 1'), (block('keep-sorted keep-sorted-format="x"', "x"), 'unsupported value "x"'),
        (block('keep-sorted keep-sorted-pattern="("', "x"), "Invalid keep-sorted-pattern expression in block a.py"), (block('keep-sorted keep-sorted-format=numeric', "1", "x"), 'defined at line 1: "x" is not a valid number'),
        (block('keep-unique="(?=x)"', "x"), "Invalid keep-unique regex pattern"), (block('line-pattern="["', "x"), "expected a valid regular expression"), ("# <block>", "is not closed"), ("# </block>", 'Failed to parse file "a.py"'),
        (block("check-lua", "x"), "check-lua requires a non-empty script path"), (block('check-lua="none"', "x"), "check-lua script error"), (block('check-ai="  "', "x"), "check-ai requires a non-empty condition"), (block('check-ai="a"', "x"), "check-ai API error"),
    ],
)
def test_what_ends_a_run(spark, src, message, monkeypatch):
    monkeypatch.delenv("TAGLOOM_AI_API_KEY", raising=False)
    with pytest.raises(ValidationError, match=message):
        run(spark, src)


def test_a_number_error_after_the_violation_is_not_reached(spark):
    assert len(run(spark, block("keep-sorted keep-sorted-format=numeric", "2", "1", "x"), enable=["keep-sorted"])) == 1


BOTH = {"a.py": '# <block name="foo" affects="b.md:bar, :gone">\nx = 1\n# </block>\n', "b.md": '[//]: # (<block name="bar">)\n\ntext\n\n[//]: # "</block>"\n'}


def edit(path, line, old, new):
    return f"--- a/{path}\n+++ b/{path}\n@@ -{line},1 +{line},1 @@\n-{old}\n+{new}\n"


def test_affects(spark):
    files = in_memory(spark, BOTH)
    one = changes_of(diff_text(spark, edit("a.py", 2, "x = 2", "x = 1")))
    got = json.loads(report(validate(files, one, Options())))["a.py"]
    assert [d["data"]["affected_block_name"] for d in got] == ["gone", "bar"] and span(got[0]) == (1, 3, 1, 46)
    assert got[1]["message"] == "Block a.py:foo at line 1 is modified, but b.md:bar is not"
    both = changes_of(diff_text(spark, edit("a.py", 2, "x = 2", "x = 1") + edit("b.md", 3, "old", "text")))
    assert [d["data"]["affected_block_name"] for d in json.loads(report(validate(files, both, Options())))["a.py"]] == ["gone"]
    tag = changes_of(diff_text(spark, edit("a.py", 1, '# <block name="fo">', BOTH["a.py"].split("\n")[0])))
    assert report(validate(files, tag, Options())) == ""
    assert [r.path for r in list_blocks(files, tag).collect()] == ["a.py"]


def test_an_unreadable_reference_only_counts_if_modified(spark):
    files = in_memory(spark, {"a.py": block("affects=", "x").replace("=>", ">")})
    assert report(validate(files)) == ""
    with pytest.raises(ValidationError, match='Invalid "affects" attribute value'):
        validate(files, changes_of(diff_text(spark, edit("a.py", 2, "y", "x"))))


def test_overlap_is_existential(spark):
    blocks = extract_blocks(in_memory(spark, {"a.py": block("a", "xxxx", "y")}))
    rows = lambda *c: spark.createDataFrame([("a.py", *x) for x in c], "path string, line bigint, ranges array<struct<s: int, e: int>>")
    marks = lambda *c: tuple(mark_modified(blocks, rows(*c)).select("is_start_tag_modified", "is_content_modified").first())
    assert marks((1, [(2, 3)])) == (True, False) and marks((1, [(0, 2)])) == (False, False) and marks((2, [(0, 1)])) == (False, True)
    assert marks((1, None)) == (True, True) and marks((4, None)) == (False, True) and marks((4, [(0, 2)])) == (False, False) and marks((5, None)) == (False, False)
    # an edit before the block, one of its tag and one of its first line: none hides another
    assert marks((1, [(0, 1)]), (1, [(3, 4)]), (2, [(0, 1)])) == (True, True)


def test_scope_of_diffs_and_globs(spark):
    files = in_memory(spark, {p: block("name=x", "a") for p in ("a.py", "d/b.py", "c.js.txt", "d/e.sh")})
    change = changes_of(diff_text(spark, edit("d/e.sh", 2, "b", "a")))
    paths = lambda c=None, **o: sorted(r.path for r in list_blocks(files, c, Options(**o)).collect())
    assert paths() == ["a.py", "d/b.py", "d/e.sh"]
    assert paths(globs=["*.py"]) == ["a.py", "d/b.py"] and paths(globs=["d/**"], ignore=["*.sh"]) == ["d/b.py"]
    assert paths(change) == ["d/e.sh"] and paths(change, globs=["a*"]) == ["a.py", "d/e.sh"] and paths(change, ignore=["d/*"]) == []


def test_formats(spark):
    names = ["x.d.ts", "CMakeLists.txt", "a/go.mod", "Makefile", "x.PY", "x.py.bak", "README", "x.tar.rs"]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    got = lambda **k: [r[0] for r in rows.select(format_of(F.col("path"), k)).collect()]
    assert got() == ["typescript", "cmake", "go", "makefile", None, None, None, "rust"]
    assert got(bak="py", ts="py") == ["python", "cmake", "go", "makefile", None, "python", None, "rust"]
    with pytest.raises(ValueError, match="Unsupported extension mapping: a=b"):
        Options(extensions={"a": "b"})


def test_selection_of_checks():
    assert Options(enable=["affects"]).names() == ["affects"] and "affects" not in Options(disable=["affects"]).names()
    with pytest.raises(ValueError, match="must not be set at the same time"):
        Options(enable=["affects"], disable=["check-ai"])
    with pytest.raises(ValueError, match="Unknown validator"):
        Options(enable=["x"])


def test_scripts_see_context(spark):
    seen = lambda ctx, content: json.dumps([ctx["file"], ctx["line"], ctx["attrs"]["check-lua"], [(a["name"], a["content"]) for a in ctx["affects"]], content])
    files = in_memory(spark, {"a.py": '# <block check-lua="s" affects="b.py:n, :m, b.py:none">\n  x\n# </block>\n# <block name=m>\n y \n# </block>\n', "b.py": block("name=n", "1") + block("name=n", "2")})
    got = json.loads(report(validate(files, None, Options(scripts={"s": seen}))))["a.py"][0]
    assert json.loads(got["data"]["lua_error"]) == ["a.py", 1, "s", [["n", "1"], ["n", "2"], ["m", "y"]], "x"] and got["data"]["script"] == "s"
    assert run(spark, block("check-lua=s", "x"), scripts={"s": lambda c, t: None}) == []
    assert len(run(spark, block("check-lua=s", "x"), scripts={"s": lambda c, t: ""})) == 1
    with pytest.raises(ValidationError, match="must return nil or a string, got: int"):
        run(spark, block("check-lua=s", "x"), scripts={"s": lambda c, t: 1})
    pattern = block('check-lua=s check-lua-pattern="(?P<value>b+)c"', "abbc")
    assert run(spark, pattern, scripts={"s": lambda c, t: t})[0]["data"]["lua_error"] == "bb"


def test_models(spark):
    client = lambda condition, content: " ok. " if "banana" in content else "no banana"
    got = run(spark, block('check-ai="mention banana"', "I like apples") + block('check-ai="mention banana"', "banana"), ai_client=client)
    assert [d["data"] for d in got] == [{"condition": "mention banana", "ai_message": "no banana"}]


def test_listing(spark):
    got = json.loads(listing(list_blocks(in_memory(spark, {"a.py": block("b=1", "x") + block('name="n"')}))))
    assert got == {"a.py": [{"attributes": {"b": "1"}, "name": "(unnamed)", "is_content_modified": False, "column": 3, "line": 1}, {"attributes": {"name": "n"}, "name": "n", "is_content_modified": False, "column": 3, "line": 4}]}


def test_nulls_and_empty_tables(spark):
    files = spark.createDataFrame([(None, "# <block>"), ("a.py", None), ("b.py", "")], "path string, content string")
    assert extract_comments(files).count() == 0 and report(validate(files)) == ""
    assert report(validate(files.where("false"))) == "" and listing(list_blocks(files.where("false"))) == "{}"


@pytest.mark.parametrize(
    "glob,yes,no",
    [("*.py", "a/b.py", "a.pyc"), ("src/**/*.rs", "src/x.rs", "x.rs"), ("**/a", "x/y/a", "xa"), ("a?[!b]{c,d}", "axzd", "axbd"), ("**", "any/thing", None), ("a.b", "a.b", "axb")],
)
def test_globs(glob, yes, no):
    import re

    assert re.search(glob_regex(glob), yes) and not (no and re.search(glob_regex(glob), no))


def test_patterns():
    texts = ["é", "a", "5", "-", "É", "_", "ab5", " ", "Ω", "a\n"]
    found = lambda p: [t for t, f in zip(texts, Linear(p).found_in(texts)) if f]
    assert found(r"^[\w--\d]$") == ["é", "a", "É", "_", "Ω"] and found(r"^[a-z&&[^b]]$") == ["a"] and found(r"[\w&&[^\d_]]") == ["é", "a", "É", "ab5", "Ω", "a\n"]
    assert found(r"\p{Alphabetic}") == ["é", "a", "É", "ab5", "Ω", "a\n"] and found(r"[\p{Greek}~~a]") == ["a", "ab5", "Ω", "a\n"]
    assert found(r"^[^\W\d]$") == ["é", "a", "É", "_", "Ω"] and found(r"\u{e9}") == ["é"] and found("a$") == ["a"] and found(r"[]-]") == ["-"]
    assert Linear(r"no: (?<value>\d+)").spans(["é no: 10", "x"]) == [(7, 9), None] and Linear(r"(n)o: (?P<value>\d+)?").selected("no: x") == "no: "
    for p in ("(?=a)", "(?<!a)b", r"(a)\1", "[", "(", "[b-a&&a]"):
        with pytest.raises(PatternError):
            Linear(p)
    assert isinstance(linear("("), str)
    began = time.process_time()
    assert Linear("^(a|aa)+$").found_in(["a" * 200_000 + "b"]) == [False] and time.process_time() - began < 2


def test_trimming(spark):
    assert spark.createDataFrame([("　 a \r\n\nb\r\n",)], "t string").select(trimmed(F.col("t"))).first()[0] == "a \r\n\nb"


def test_carriage_returns_are_no_part_of_lines(spark):
    got = run(spark, '# <block keep-unique="[a-z ]+">\r\n a\r\nb\r\n a\r\n# </block>\r\n', enable=["keep-unique"])
    assert [span(d) for d in got] == [(4, 1, 4, 2)]


def test_checks_of_ones_own(spark):
    def named(blocks):
        bare = blocks.where(~F.map_contains_key("attrs", F.lit("name")))
        return bare.select("path", F.col("tag_start").alias("start"), F.col("tag_end").alias("end"), F.lit("named").alias("code"), F.lit("no name").alias("message"), F.lit(2).cast("tinyint").alias("severity"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("string").alias("error"))

    files = in_memory(spark, {"a.py": block("name=x", "1") + block("b", "2")})
    assert [d["range"]["start"]["line"] for d in json.loads(report(validate(files, None, Options(checks={"named": named}))))["a.py"]] == [4]
    assert report(validate(files, None, Options(checks={"named": named}, disable=["named"]))) == ""
    with pytest.raises(ValueError, match="exists"):
        Options(checks={"affects": named})


def test_all_checks_parse_files_once(spark):
    files = in_memory(spark, {"a.py": block('line-count="==0" keep-sorted', "b", "a"), "b.py": block('name="n" affects=":gone"', "x"), "c.py": "# <block line-count=>\n"})
    got = file_violations(files, None, Options(disable=["check-ai", "check-lua"]))
    assert sorted((r.path, r.code) for r in got.collect()) == [("a.py", "keep-sorted"), ("a.py", "line-count")]
    local = file_violations(files, None, Options(enable=["line-count", "keep-sorted", "keep-unique", "line-pattern"]))
    assert local._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2


def test_long_batches_are_parsed_in_bounded_parts():
    import pyarrow as pa

    from tagloom.operators.extract import SLICE_CHARS, SLICE_ROWS, sliced

    texts = ["x" * (SLICE_CHARS // 3 + 1)] * 7 + ["y" * (3 * SLICE_CHARS)] + ["z", None] * SLICE_ROWS
    batch = pa.RecordBatch.from_pydict({"path": list(map(str, range(len(texts)))), "content": texts}).slice(1)
    parts = list(sliced(batch))
    assert [t for _, part in parts for t in part] == texts[1:] and [int(p) for part, _ in parts for p in part] == list(range(1, len(texts)))
    assert all(len(p) == 1 or len(p) <= SLICE_ROWS and sum(len(t or "") for t in p) <= SLICE_CHARS for _, p in parts)
    assert list(sliced(batch.slice(0, 0))) == []


def test_blocks_and_errors_become_columns():
    from tagloom.operators.extract import BLOCKS_ARROW, _block_batch

    rows = [("a", 0, {"x": "", "y": "é"}, (1, 3), (1, 9), "t", 9, 10, (1, 9), (2, 1), None), ("b", *[None] * 9, "bad"), ("c", 0, {}, (2, 3), (2, 9), "", 0, 0, (1, 1), (1, 1), None)]
    got = _block_batch(rows)
    got.validate(full=True)
    assert got.schema == BLOCKS_ARROW and _block_batch([]).num_rows == 0
    place = lambda p: p and {"line": p[0], "character": p[1]}
    expected = [[r[0], r[1], None if r[2] is None else list(r[2].items()), place(r[3]), place(r[4]), *r[5:8], place(r[8]), place(r[9]), r[10]] for r in rows]
    assert [list(r.values()) for r in got.to_pylist()] == expected


@pytest.mark.parametrize("check", ["keep-sorted", "keep-unique", "line-pattern", "line-count"])
def test_files_are_checked_as_their_blocks_are(spark, check):
    from tagloom.operators.extract import extract_blocks
    from tagloom.operators.local import local_checks, local_file_checks

    attrs = {"keep-sorted": "keep-sorted", "keep-unique": "keep-unique", "line-pattern": 'line-pattern="^[a-z]+$"', "line-count": 'line-count="<2"'}[check]
    own = {f"f{i}.py": block(f'{attrs} name="n{i}"', *lines) for i, lines in enumerate([("b", "a"), ("a", "a"), ("é1", "é1", " é"), (), ("a",)])}
    files = in_memory(spark, own | {"bad.py": f"# <block {attrs}>\n", "other.py": block("name=x", "b", "a"), "two.py": own["f0.py"] * 2, "a.b.ts": "// <block " + attrs + ">\nb\na\n// </block>", "wrong.py": block(f"{attrs} severity=odd", "b", "b", "a1")})
    found = local_file_checks(files, [check])
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    expected = local_checks(extract_blocks(files).where("error is null"), [check])
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and not found.isEmpty()


@pytest.fixture
def tree(tmp_path):
    for path, text in {
        ".git/x": "", "a.py": block('line-count="==0"', "x"), "pkg/__init__.py": block("name=i", "1"), ".hidden/h.py": "# <block>", "out/gen.py": "# <block>", "pkg/skip.py": "# <block>", "pkg/keep.py": "",
        ".gitignore": "/out\nskip*\n!keep.py\n# no\n", ".git/info/exclude": "own*\n", "own.py": "# <block>",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_repository_source(spark, tree):
    assert list(walk(str(tree))) == ["a.py", "pkg/__init__.py", "pkg/keep.py"]
    assert list(walk(str(tree / "pkg"))) == ["__init__.py", "keep.py"]
    assert find_root(str(tree / "pkg")) == str(tree)
    assert sorted(r.path for r in read_repo(spark, str(tree), ["pkg/*"], ["*keep*"]).collect()) == ["pkg/__init__.py"]
    os.symlink("/etc/hostname", tree / "link.py")
    with pytest.raises(ValueError, match="outside the root"):
        contained(str(tree), "link.py")
    with pytest.raises(ValueError, match="outside the root"):
        contained(str(tree), "../x")


class Tty(io.StringIO):
    def isatty(self):
        return True


def test_command_line(spark, tree, capsys):
    go = lambda *a, stdin=None: cli.main(list(a), spark, stdin or Tty(), str(tree))
    assert go() == 1 and list(json.loads(capsys.readouterr().err)) == ["a.py"]
    assert go("pkg/*") == 0 and capsys.readouterr().err == ""
    assert go("-d", "line-count") == 0 and go("--ignore", "a*") == 0
    assert go("list", "pkg/**") == 0 and list(json.loads(capsys.readouterr().out)) == ["pkg/__init__.py"]
    assert go(stdin=io.StringIO(edit("pkg/__init__.py", 2, "2", "1"))) == 0
    assert go("list", "--diff", stdin=io.StringIO(edit("pkg/__init__.py", 2, "2", "1"))) == 0
    assert json.loads(capsys.readouterr().out)["pkg/__init__.py"][0]["is_content_modified"] is True
    assert go("a*", "list", "pkg/**") == 0 and list(json.loads(capsys.readouterr().out)) == ["a.py", "pkg/__init__.py"]
    assert go("-e", "affects", "-d", "affects") == 1 and "must not be set" in capsys.readouterr().err


def test_command_line_on_files_that_are_no_text_or_gone(spark, tree, capsys):
    go = lambda *a, stdin=None: cli.main(list(a), spark, stdin or Tty(), str(tree))
    (tree / "logo.png").write_bytes(b"\x89PNG\xff\xfe")
    assert go("-d", "line-count") == 0 and capsys.readouterr().err == ""
    emptied = "--- a/gone.py\n+++ b/gone.py\n@@ -1,2 +0,0 @@\n-a\n-b\n"
    assert go(stdin=io.StringIO(emptied + edit("logo.png", 1, "a", "b") + edit("pkg/__init__.py", 2, "2", "1"))) == 0 and capsys.readouterr().err == ""
    assert go("-E", "png=html") == 1 and "codec can't decode" in capsys.readouterr().err
    assert go(stdin=io.StringIO(edit("missing.py", 1, "a", "b"))) == 1 and "No such file" in capsys.readouterr().err


def test_stream_of_diffs(spark, tmp_path):
    (tmp_path / "diffs").mkdir()
    (tmp_path / "diffs/1.txt").write_text(edit("a.py", 2, "x = 2", "x = 1"))
    validate_stream(spark, str(tmp_path / "diffs"), in_memory(spark, BOTH), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert read_diff(spark, str(tmp_path / "diffs")).count() == 1


def test_lines_are_counted_from_the_tag(spark):
    # the first content line is what follows the comment, even where the comment ends on a later line
    src = "/* <block keep-sorted>\n */\nb\na\n/* </block> */\n"
    assert span(run(spark, src, "a.c")[0]) == (3, 1, 3, 1)


def test_blocks_are_values_of_rows(spark):
    row = extract_blocks(in_memory(spark, {"a.py": block("é=ü", "ñ")})).first()
    assert row.content == "\nñ\n" and row.attrs == {"é": "ü"} and row.tag_end.character == 15 and v.UNNAMED == "(unnamed)"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "nation"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, SF), db.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(dict(zip(rel.columns, r))[c] for c in df.columns) for r in rel.fetchall()), key=repr) != []
