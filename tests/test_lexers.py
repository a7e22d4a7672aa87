"""Comments and blocks of all formats."""

import random

import pytest

from tagloom.functions.lexers import EXTENSIONS, FORMATS, comments, format_name
from tagloom.functions.tags import BlockError, attributes, blocks, may_have_tags, tags


def texts(src: str, fmt: str) -> list[str]:
    raw = src.encode()
    got = comments(raw, fmt)
    for a, b, t in got:
        assert len(t) == b - a
        assert [i for i, c in enumerate(t) if c == 10] == [i for i, c in enumerate(raw[a:b]) if c == 10]
    assert got == sorted(got)
    return [t.decode().strip() for _, _, t in got]


def test_table_is_complete():
    assert len(FORMATS) == 35 and len(EXTENSIONS) == 68 and set(EXTENSIONS.values()) == set(FORMATS)


HASH = "x = 1 # one\n# two\n"
SLASH = "int x; // one\n/* two\n * three */ y;\n"
CASES = {
    "bash": ("#!/bin/bash\necho $# ${v#p} 'a # b' \"c # d\" e#f # one\n# two\ncat <<EOF\n# no\nEOF\n", ["one", "two"]),
    "c": (SLASH + "char *s = \"// no\"; char c = '\"'; // last\n", ["one", "two\n   three", "last"]),
    "c_sharp": ("/// one\nvar s = @\"c:\\\"; // two\n", ["one", "two"]),
    "cmake": ("#[[ one\nmore ]]\nset(x \"# no\") # two\n#[==[ ]] three ]==]\n", ["one\nmore", "two", "]] three"]),
    "cpp": ('auto s = R"x(// no)x"; // one\n' + SLASH, ["one", "one", "two\n   three"]),
    "css": ("a { b: url(//c); } /* one */ /* two */ // no\n", ["one", "two"]),
    "dart": ("/// one\nvar s = r'// no'; /* a /* b */ c */\n", ["one", "a /* b */ c"]),
    "dockerfile": ("# one\nRUN echo a # no\n  # two\n", ["one", "two"]),
    "elixir": ('x = """\n# no\n"""\ny = ~s(# no) # one\n', ["one"]),
    "go": ("x := `// no` // one\n/* two */\n", ["one", "two"]),
    "graphql": ('"""\n# no\n"""\ntype A { b: C } # one\n', ["one"]),
    "groovy": ("def x = '''// no''' // one\n/* two */", ["one", "two"]),
    "hcl": ('a = "# no" # one\nb = 1 // two\n/* three */\nc = <<EOT\n# no\nEOT\n', ["one", "two", "three"]),
    "html": ("<p><!-- one --></p><script>var a = '<!-- no -->';</script><!--two-->", ["one", "two"]),
    "java": ("/// one\nString s = \"/* no */\"; // two\n/* three */", ["one", "two", "three"]),
    "javascript": ("let r = /[/*]/; let t = `// ${'no'}`; // one\n<!-- two\n--> three\n/* four */ a / b // five\n", ["one", "two", "three", "four", "five"]),
    "kotlin": ('val s = """// no""" // one\n/* a /* b */ c */', ["one", "a /* b */ c"]),
    "lua": ("s = [[-- no]] -- one\n--[==[ two\n]] three ]==]\n--\n", ["one", "two\n]] three", ""]),
    "makefile": ("# one\na: b # two\n\techo 'x' # no\nc = \\# no\n", ["one", "two"]),
    "markdown": ("[//]: # (one)\n\ntext <!-- two --> `<!-- no -->`\n\n```\n<!-- no -->\n```\n\n<!-- three\n\nstill -->\n\n[//]: # \"four\"\n", ["one", "two", "three\n\nstill", "four"]),
    "nix": ("x = ''\n# no\n''; # one\n/* two */ y = \"# no\";", ["one", "two"]),
    "php": ("<!-- one --><?php // two ?><p><?php $x = '# no'; # three\n/* four */ ?><!-- fi<?php echo 1; ?>ve -->", ["one", "two", "three", "four", "fi                ve"]),
    "proto": (SLASH, ["one", "two\n   three"]),
    "python": (HASH + 's = "# no" + \'# no\' + """\n# no\n"""\n', ["one", "two"]),
    "ruby": ("x = \"#{y} # no\" # one\n=begin two\nthree\n=end\n%w(# no)\n", ["one", "two\nthree"]),
    "rust": ("/// one\n//! two\n// three\nfn f<'a>(x: &'a str) { r#\"// no\"#; } /* a /* b */ c */", ["one", "two", "three", "a /* b */ c"]),
    "scala": ('val s = """// no""" // one\n/* two */', ["one", "two"]),
    "sql": ("select '-- no', \"/* no */\" -- one\n/* two\n * three */", ["one", "two\n   three"]),
    "starlark": (HASH, ["one", "two"]),
    "swift": ('/// one\nlet s = #"// no"# // two\n/* a /* b */ c */', ["one", "two", "a /* b */ c"]),
    "toml": ("a = '''\n# no\n''' # one\nb = \"# no\"\n", ["one"]),
    "tsx": (SLASH, ["one", "two\n   three"]),
    "typescript": (SLASH + "let s: string = '// no';", ["one", "two\n   three"]),
    "xml": ("<a><!-- one\ntwo --><![CDATA[<!-- no -->]]></a>", ["one\ntwo"]),
    "yaml": ("a: 'x # no' # one\nb: x#no\nc: | # two\n  # no\n# three\n", ["one", "two", "three"]),
}


@pytest.mark.parametrize("fmt", sorted(FORMATS))
def test_comments(fmt):
    src, expected = CASES[fmt]
    assert texts(src, fmt) == expected


def test_rust_doc_comments_hold_their_line_break():
    assert comments(b"/// a\n// b\n", "rust") == [(0, 6, b"    a\n"), (6, 10, b"   b")]


def test_reference_comments_hold_their_line_break():
    assert comments(b"# t\n\n[//]: # (<block>)\nx\n", "markdown") == [(5, 23, b"         <block> \n")]


def test_spans_on_one_line():
    (b,) = blocks(b'/* <block> */ let abc = "xy"; /* </block> */', "rust")
    assert (b.tag_start, b.tag_end) == ((1, 4), (1, 10))
    assert (b.content_byte_start, b.content_byte_end, b.content_start, b.content_end) == (13, 30, (1, 14), (1, 31))


def test_tag_over_lines_and_shared_comment():
    (b,) = blocks(b"/* <block\n> */ x /* </block> */", "c")
    assert (b.tag_start, b.tag_end) == ((1, 4), (2, 1))
    (b,) = blocks(b"/* <block a></block> */", "c")
    assert (b.content_byte_start, b.content_byte_end) == (0, 0) and b.content_start > b.content_end
    assert len(blocks(b"/* <block> */ a /* </block><block> */ b /* </block> */", "c")) == 2


def test_nesting_sorts_by_start():
    src = b"# <block name=a>\nx\n# <block name=b>\ny\n# </block>\n# </block>\n# <block name=c>\n# </block>\n"
    got = blocks(src, "python")
    assert [b.attrs["name"] for b in got] == ["a", "b", "c"]
    assert src[got[0].content_byte_start : got[0].content_byte_end] == b"\nx\n# <block name=b>\ny\n# </block>\n"


@pytest.mark.parametrize(
    "src,message",
    [(b"# </block>", "Unexpected closed block at line 1, position 2"), (b"# <block>\n# <block>\n# </block>", "Block at line 1 is not closed"), (b"# <block a=>\n# </block>", "Unexpected closed block at line 2, position 15")],
)
def test_tags_that_do_not_pair(src, message):
    with pytest.raises(BlockError, match=message):
        blocks(src, "python")


@pytest.mark.parametrize(
    "tag,expected",
    [
        ("<block>", {}), ("<block a>", {"a": ""}), ('<block a="b c">', {"a": "b c"}), ("<block a='>' b = c >", {"a": ">", "b": "c"}), ("<block a=1 a=2>", {"a": "2"}),
        ('<block a="&quot;">', {"a": "&quot;"}), ('<block naïve="ü">', {"naïve": "ü"}), ('<block a="x\ny">', {"a": "x\ny"}),
    ],
)
def test_attributes(tag, expected):
    assert tags(tag) == [(0, len(tag), expected)]


@pytest.mark.parametrize("text", ["<blocks>", "< block>", "<p>", "<<", "<block a=>", "<block a=b=c>", '<block a="b>', "</blocks>"])
def test_what_is_no_tag(text):
    assert tags(text) == []


def test_end_tags_take_space():
    assert [t[2] for t in tags("< / block > </block\n>")] == [None, None]
    assert attributes("") == {}


def test_noise_around_one_pair_leaves_one_block():
    rng = random.Random(1)
    alphabet = "<>/ablock=\"'\n \té€"
    for _ in range(300):
        noise = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        if any(tags(n) for n in noise) or any("<block" in n for n in noise):
            continue
        quiet = [n.replace("<", "(").replace("\n", " ") for n in noise]
        src = f"# {quiet[0]}\n# <block>\n# {quiet[1]}\n# </block>\n# {quiet[2]}".encode()
        assert len(blocks(src, "python")) == 1
    assert may_have_tags(b"x < / block") and not may_have_tags(b"<bloc")


def test_comments_of_a_dockerfile_hold_their_line_breaks():
    src = b"\n# syntax=a:1\nFROM x\n\nRUN echo hi # no\n\n  # deep\nCOPY . /app\n# last"
    assert comments(src, "dockerfile") == [(1, 14, b"  syntax=a:1\n"), (42, 49, b"  deep\n"), (61, 67, b"  last")]


@pytest.mark.parametrize("path,remap,expected", [("a/b.py", None, "python"), ("x.d.ts", None, "typescript"), ("Dockerfile", None, "dockerfile"), ("logo.png", None, None), ("a.tpl", {"tpl": "html"}, "html"), ("Makefile.am", None, None), ("py", None, "python"), (".gitignore", None, None)])
def test_formats_of_paths(path, remap, expected):
    assert format_name(path, remap) == expected
