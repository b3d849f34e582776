"""``python -m mensura check|coverage|interactions|units|init ...``

Exit codes: 0 nothing wrong, 1 errors found, 2 it couldn't be checked.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

UNUSABLE = 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mensura")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "coverage", "interactions"):
        s = sub.add_parser(name)
        if name == "interactions":
            s.add_argument("symbol")
            s.add_argument("--scope")
            s.add_argument("--file")
        s.add_argument("paths", nargs="+")
        s.add_argument("--scale", action="store_true", help="scales and zero points count")
        s.add_argument("--summary", action="store_true", help="counts by file alone")
        s.add_argument("--trace", action="store_true", help="the rule behind each finding")
        s.add_argument("--quiet", action="store_true", help="no text, the exit code alone")
        s.add_argument("--timings", action="store_true")
        s.add_argument("--cache", metavar="FOLDER", help="findings of earlier runs")
        s.add_argument("--workspace", metavar="FOLDER", help="a tree that holds what the paths use and call")
        s.add_argument("-D", dest="defines", action="append", default=[], metavar="NAME[=VALUE]", help="a macro of the preprocessor")
        s.add_argument("-I", dest="includes", action="append", default=[], metavar="FOLDER", help="where included files are")
    sub.add_parser("units")
    sub.add_parser("show-defaults")
    s = sub.add_parser("init")
    s.add_argument("-t", "--templates", default="", help="disciplines, parted by commas")
    s.add_argument("-o", "--output", default="mensura.toml")
    s.add_argument("--force", action="store_true")
    return p


def fail(why: str) -> int:
    print(f"mensura: {why}", file=sys.stderr)
    return UNUSABLE


def init(args: argparse.Namespace) -> int:
    from . import templates

    out = Path(args.output)
    try:
        text = templates.project([t.strip() for t in args.templates.split(",") if t.strip()])
    except ValueError as e:
        print(f"mensura: {e}", file=sys.stderr)
        return 1
    if out.exists() and not args.force:
        return fail(f"{out} is there already; --force writes over it")
    out.write_text(text)
    return 0


def main(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    if args.command == "units":
        from .units import default_catalog, describe

        c = default_catalog()
        print("\n".join(f"{n}\t{describe(c.find(n), factor=True)}\t{c.kinds.get(n, '')}" for n in sorted({*c.base, *c.derived})))
        return 0
    if args.command == "show-defaults":
        from . import templates

        print(templates.defaults(), end="")
        return 0
    if args.command == "init":
        return init(args)
    local = [p for p in args.paths if "://" not in p]
    if missing := [p for p in local if not Path(p).exists()]:
        return fail(f"not there: {', '.join(missing)}")
    from . import settings

    own = settings.load(settings.find(Path(local[0] if local else ".").resolve()))
    if own.problem:
        return fail(f"settings can't be used: {own.problem}")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import check, report, workset
    from .sources.files import read_headers, read_sources

    began = time.time()
    own.scale |= args.scale
    own.defines |= dict(d.partition("=")[::2] for d in args.defines)
    own.includes += tuple(args.includes)
    spark = SparkSession.builder.appName("mensura").getOrCreate()
    sources = read_sources(spark, args.paths, own.exclude)
    if sources.limit(1).isEmpty():
        return fail("no sources")
    asked = sources.select("path")
    if args.workspace:
        sources = workset.workset(read_sources(spark, [args.workspace, *args.paths], own.exclude), asked)
    checked = check.check(sources, own, args.cache, read_headers(spark, list(own.includes)) if own.includes else None)
    if args.workspace:
        checked.diagnostics = checked.diagnostics.join(asked, "path", "left_semi")
    seen = time.time()
    say = (lambda lines: None) if args.quiet else (lambda lines: [print(x) for x in lines])
    code = 0
    if args.command == "check":
        say(report.summary_lines(checked) if args.summary else report.diagnostics_lines(checked, args.trace))
        code = report.exit_code(checked)
    elif args.command == "coverage":
        say(report.coverage_json(checked))
    else:
        say(report.interactions_lines(checked, args.symbol, args.file, args.scope, own.scale))
        clashes = report.interactions(checked, args.symbol, args.file, args.scope, own.scale)[1]
        code = int(not clashes.limit(1).isEmpty())
    if args.timings:
        files = checked.facts.where(F.col("fact") == "file").count()
        print(f"checked {seen - began:.1f} s, reported {time.time() - seen:.1f} s, {files} files", file=sys.stderr)
        for r in report.histogram(checked).orderBy("code").collect():  # a row for each of the few codes
            print(f"{r['code']} {r['severity']} {r['n']}", file=sys.stderr)
    checked.close()
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
