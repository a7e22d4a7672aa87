"""Unified diffs, and the ranges of changed characters."""

import random

import pytest

from tagloom.functions.diffs import DiffError, _characters, _snake, _table_snake, _wide_snake, align, changed_ranges, changes, in_common, merged, opcodes, ratio


@pytest.mark.parametrize(
    "old,new,expected",
    [
        ("box", "box", []), ("box", "for", [(0, 1), (2, 3)]), ("boxes", "faxed", [(0, 2), (4, 5)]), ("box", "aboxa", [(0, 1), (4, 5)]), ("box", "2 boxes", [(0, 2), (5, 7)]),
        ("abracadabra", "cadabra", [(0, 1)]), ("abracadabra", "abra", [(3, 4)]), ("abracadabra", "cdar", [(0, 2), (3, 4)]),
        ("there was three", "there is thora", [(6, 7), (11, 12), (13, 14)]), ("one", "modified one", [(0, 9)]), ("three white rabbits", "three rabbits", [(6, 7)]), ("five brown foxes", "five own boxes", [(5, 6), (9, 10)]),
    ],
)
def test_changed_ranges(old, new, expected):
    assert changed_ranges(old, new) == expected


def common(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_edit_scripts_are_minimal_and_lead_from_old_to_new():
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ab c") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))) for _ in range(400)]
    pairs += [("x = 1 + 2 * y", "y = x * 2 + 1"), ("", ""), ("", "a"), ("a", "")]
    for old, new in pairs:
        script = opcodes(old, new)
        out, at = "", 0
        for kind, a, b, c, d in script:
            assert (a < b) == (kind != "insert") and (c < d) == (kind != "delete")
            out += old[at:a] + new[c:d]
            at = b
        assert out + old[at:] == new
        assert len(old) - sum(b - a for _, a, b, _, _ in script) == common(old, new)
        assert old == new == "" or ratio(old, new) == 2 * common(old, new) / (len(old) + len(new))


def test_long_lines_as_short_ones():
    rng = random.Random(2)
    for _ in range(300):
        old, new = ("".join(rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 40))) for _ in range(2))
        while old and new and old[0] == new[0]:
            old, new = old[1:], new[1:]
        while old and new and old[-1] == new[-1]:
            old, new = old[:-1], new[:-1]
        if old and new:
            assert _table_snake(old, new) == _wide_snake(_characters(old), _characters(new)) == _snake(old, new), (old, new)
    for n, m, letters in [(300, 250, "ab"), (120, 400, "abcdefgh "), (500, 501, "abc"), (260, 300, "xyz€𝄞"), (350, 60, "a"), (1, 600, "ab"), (600, 1, "abc")]:
        old, new = ("".join(rng.choice(letters) for _ in range(k)) for k in (n, m))
        assert _wide_snake(_characters(old), _characters(new)) == _table_snake(old, new) == _snake(old, new)
        script = opcodes(old, new)
        assert len(old) - sum(b - a for _, a, b, _, _ in script) == common(old, new) == in_common(old, new)
    edited = "word " * 4000
    assert changed_ranges(edited, edited[:9000] + "#" + edited[9000:]) == [(9000, 9001)]


def test_executors_compare_as_python_does(spark):
    from tagloom.functions.native import changed_ranges as native

    rng = random.Random(3)
    texts = lambda: ("".join(rng.choice("abcde€𝄞 "[: rng.randint(1, 8)]) for _ in range(rng.randint(0, rng.choice([3, 9, 40, 150])))) for _ in range(2))
    pairs = [(*texts(), n) for n in range(600)] + [("a€" * 300, "b" + "a€" * 290, 600), (None, "a", 601), ("word " * 400, "ward " * 900, 602)]
    rows = spark.createDataFrame(pairs, "old string, new string, n int")
    got = {r.n: r.ranges for r in rows.select("n", native(spark)(rows.old, rows.new).alias("ranges")).collect()}
    for old, new, n in pairs:
        assert got[n] == (None if old is None else changed_ranges(old, new)), (old, new)


def test_emptied_files_are_as_removed_ones():
    assert changes("--- a/gone.py\n+++ b/gone.py\n@@ -1,4 +0,0 @@\n-a\n-b\n-c\n-d\n--- a/x\n+++ b/x\n@@ -1,1 +1,1 @@\n-a\n+b\n") == {"x": [(1, [(0, 1)])]}
    assert changes(diff("f", "@@ -5,2 +4,0 @@\n-a\n-b\n")) == {"f": [(5, None)]}


def test_merging():
    assert merged([(6, 8), (1, 2), (8, 10), (3, 4)]) == [(1, 2), (3, 4), (6, 10)]


def diff(path, *hunks):
    return f"--- a/{path}\n+++ b/{path}\n" + "".join(hunks)


def test_insertions_deletions_and_edits():
    assert changes(diff("f", "@@ -1,2 +1,3 @@\n a\n+b\n c\n")) == {"f": [(2, None)]}
    assert changes(diff("f", "@@ -1,4 +1,2 @@\n a\n-b\n-c\n d\n")) == {"f": [(2, None)]}
    assert changes(diff("f", "@@ -1,3 +1,1 @@\n-a\n b\n-c\n")) == {"f": [(1, None), (2, None)]}
    assert changes(diff("f", "@@ -1,1 +1,1 @@\n-one\n+two\n\\ No newline at end of file\n"))["f"][0][0] == 1
    assert changes(diff("f", "@@ -5,2 +4,0 @@\n-a\n-b\n")) == {"f": [(5, None)]}


def test_similar_lines_are_paired():
    got = changes(diff("f", "@@ -1,2 +1,3 @@\n-alpha beta\n-gamma delta\n+new line here\n+alpha beta!\n+gamma delta?\n"))
    assert got["f"][0] == (1, None) and got["f"][1] == (2, [(10, 11)]) and got["f"][2] == (3, [(11, 12)])
    assert align(["x"] * 101, ["x"] * 100) == list(range(100))
    assert align(["a" * 40_000], ["b", "a" * 40_000]) == [0, None]
    assert align([], ["a"]) == [None]


def test_files():
    text = "--- a/x\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-a\n--- /dev/null\n+++ b/b/y\n@@ -0,0 +1,2 @@\n+a\n+b\n"
    assert changes(text) == {"y": [(1, None), (2, None)]}
    assert changes("") == {}


@pytest.mark.parametrize("path", ["../x", "a/../../x", "/etc/x"])
def test_paths_that_leave_the_root(path):
    with pytest.raises(DiffError, match="escapes the repository root folder"):
        changes(f"--- a/x\n+++ {path}\n@@ -1,1 +1,1 @@\n-a\n+b\n")


def test_hunks_out_of_order():
    with pytest.raises(DiffError, match="a change at line 1 follows a change at line 9"):
        changes(diff("f", "@@ -9,0 +9,1 @@\n+x\n", "@@ -1,0 +1,1 @@\n+y\n"))
