"""python -m sumire [--config C] [--format F] [--fix] [--stdin] [--max-warnings N] [--list-rules] files..."""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    from sumire.plans.config import RULE_IDS, Config, ConfigError

    p = argparse.ArgumentParser(prog="sumire")
    p.add_argument("files", nargs="*")
    p.add_argument("--config")
    p.add_argument("--format", default="text", choices=("text", "json", "textlint"))
    for flag in ("--fix", "--stdin", "--list-rules"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--stdin-filename", default="<stdin>")
    p.add_argument("--max-warnings", type=int)
    a = p.parse_args(argv)
    try:
        config = Config.load(a.config) if a.config else Config.load("sumire.yml") if os.path.exists("sumire.yml") else Config()
    except (ConfigError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    if a.list_rules:
        print("\n".join(r for r in RULE_IDS if config.enabled(r)))
        return 0
    if not a.files and not a.stdin:
        p.print_usage(sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from sumire.operators import lint, report
    from sumire.sources.files import read_files, read_text

    spark = SparkSession.builder.getOrCreate()
    docs = None
    if a.stdin:
        docs = read_text(spark, sys.stdin.read(), a.stdin_filename)
    if a.files:
        files = read_files(spark, [os.path.abspath(f) for f in a.files])
        docs = files if docs is None else docs.unionByName(files)
    out = (lint.fix if a.fix else lint.lint)(docs, config).persist()
    try:
        total = lint.summary(out).first()
    except Exception as e:  # noqa: BLE001  any read error ends the run
        print(e, file=sys.stderr)
        return 2
    to = sys.stdout
    if a.fix:
        for r in report.rewritten(out).where("path <> '%s'" % a.stdin_filename.replace("'", "\\'")).toLocalIterator():
            with open(r.path, "w", encoding="utf-8", newline="") as f:
                f.write(r.source)
        if a.stdin:
            print(out.where("path_ord = -1").first().fixed.source, end="")
            to = sys.stderr
    print(report.render(out, a.format), end="", file=to)
    if a.format == "text":
        if a.fix:
            print(f"{total.fixed} fix(es) applied", file=sys.stderr)
        print(f"{total.errors} error(s), {total.warnings} warning(s)", file=sys.stderr)
    return int(config.fails(total.errors, total.warnings, a.max_warnings))


if __name__ == "__main__":
    sys.exit(main())
