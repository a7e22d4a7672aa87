"""Command line: ``python -m tagloom.cli [GLOBS] | list [--diff] [GLOBS]``."""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .plans.engine import VALIDATORS, Options, ValidationError, changes_of, has_errors, list_blocks, listing, report, validate
from .sources.repo import diff_text, find_root, read_repo


def _pair(text: str) -> tuple[str, str]:
    key, sep, value = text.partition("=")
    if not sep:
        raise argparse.ArgumentTypeError(f"invalid KEY=VALUE: no `=` found in `{text}`")
    return key.strip(), value.strip()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tagloom", description="Checks annotated blocks in comments.")
    p.add_argument("--ignore", action="append", default=[], metavar="GLOB")
    p.add_argument("-E", "--extension", action="append", default=[], type=_pair, metavar="KEY=VALUE")
    p.add_argument("-d", "--disable", action="append", default=[], choices=VALIDATORS)
    p.add_argument("-e", "--enable", action="append", default=[], choices=VALIDATORS)
    p.add_argument("--diff", action="store_true", help="with list: read a diff from standard input")
    p.add_argument("globs", nargs="*", help="globs of files to scan; `list` first lists blocks instead of checking them")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin=None, root: str | None = None) -> int:
    args = parser().parse_args(argv)
    stdin = sys.stdin if stdin is None else stdin
    # globs may stand before and after the command; they count alike
    wants_list = "list" in args.globs
    globs = [g for k, g in enumerate(args.globs) if not wants_list or k != args.globs.index("list")]
    try:
        options = Options(globs=globs, ignore=args.ignore, extensions=dict(args.extension), enable=args.enable, disable=args.disable)
        piped = (args.diff or not wants_list) and not stdin.isatty()
        text = stdin.read() if piped else ""
        spark = spark or SparkSession.builder.appName("tagloom").getOrCreate()
        root = root or find_root()
        changes = changes_of(diff_text(spark, text)) if text.strip() else None
        if changes is not None and not globs:
            # with a diff alone nothing is walked: exactly the files that it names are read
            files = read_repo(spark, root, ignore=args.ignore, extensions=options.extensions, paths=[r.path for r in changes.select("path").distinct().collect()])
        elif changes is not None:
            files = read_repo(spark, root, ignore=args.ignore, extensions=options.extensions)
        else:
            files = read_repo(spark, root, globs, args.ignore, extensions=options.extensions)
        if wants_list:
            print(listing(list_blocks(files, changes, options)))
            return 0
        found = validate(files, changes, options)
        if out := report(found):
            print(out, file=sys.stderr)
        return int(has_errors(found))
    except (ValidationError, ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    except PySparkException as e:
        # an error in a task arrives with the worker's stack; its cause is the last line that names an exception
        causes = re.findall(r"^\s*[\w.]*(?:Error|Exception): .+$", str(e), re.M)
        print(f"Error: {(causes or [str(e)])[-1].strip()}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
