"""scan and init on the command line. Exit codes: 0 passed, 1 gate failed, 2 error."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import __version__
from tessera.functions.scoring import GRADE_ORDER
from tessera.operators import clones, rollups, routing, rules, structure
from tessera.sinks import reports
from tessera.session import kept
from tessera.sources import cache, config, files, notebooks

FORMATS = ("table", "json", "sarif", "html")


#: A scan of more files than this is announced before it starts.
MANY_FILES = 50_000


def measure(spark: SparkSession, routed: DataFrame, folder: str | None) -> DataFrame:
    """structure.analyze() of routed files; with a cache folder, only texts that it doesn't know are measured, and then kept there."""
    if folder is None:
        return structure.analyze(routed)
    skipped, keyed = routed.where("tier = 3"), cache.with_key(routed.where("tier <> 3"))
    known = cache.read(spark, folder, keyed)
    fresh = structure.analyze(keyed if known is None else cache.misses(keyed, known))
    own = ["path", "language_key", "text", "skip_reason"]
    cache.append(fresh.drop(*own), folder)
    stored = cache.read(spark, folder, keyed)
    whole = keyed.select("content_key", *own).join(fresh.drop(*own) if stored is None else stored, "content_key").drop("content_key")
    return whole.unionByName(structure.analyze(skipped).select(*whole.columns))


def analyze_files(raw: DataFrame, limits: rules.Thresholds, folder: str | None = None) -> DataFrame:
    """Files as read (path, language_key, text, skip_reason) with measurements, findings, suppressions and scores."""
    unread = raw.where("skip_reason IS NOT NULL").select("path", "language_key", "text", F.lit(3).alias("tier"), "skip_reason", F.lit(None).cast("string").alias("note"))
    notes = raw.where("skip_reason IS NULL AND language_key LIKE 'notebook:%'")
    books = notebooks.as_python(notes).drop("skip_reason")
    bad = books.where("NOT valid").select("path", "language_key", "text", F.lit(3).alias("tier"), F.lit("invalid notebook").alias("skip_reason"), F.lit(None).cast("string").alias("note"))
    plain = raw.where("skip_reason IS NULL AND language_key NOT LIKE 'notebook:%'").drop("skip_reason")
    routed = routing.route(plain.unionByName(books.where("valid").drop("valid"))).unionByName(unread).unionByName(bad)
    measured = kept(measure(raw.sparkSession, routed, folder))
    blocks = clones.clone_blocks(structure.token_stream(measured), limits.duplication_tokens)
    named = structure.rename_in_notebooks(measured.drop("ids", "token_lines"), notebooks.code_lines(notes))
    return rollups.score_files(rules.apply_suppressions(rules.evaluate(clones.with_blocks(named, blocks), limits, "blocks")))


def scan(spark: SparkSession, root: str, formats: tuple[str, ...] = ("table",), out: str | None = None, min_grade: str | None = None, use_gate: bool = True, quiet: bool = False, cache_folder: str | None = None) -> int:
    if min_grade is not None and min_grade.upper() not in GRADE_ORDER:
        raise ValueError(f"no such grade: {min_grade}")
    settings = config.load_config(root)
    for p in settings.problems:
        print(f"{config.FILE_NAME}: {p}", file=sys.stderr)
    listed = files.list_files(root, settings.exclude)
    if not listed:
        raise ValueError("no source files")
    if len(listed) > MANY_FILES and not quiet:
        print(f"{len(listed)} files: this may take a while", file=sys.stderr)
    limits, _ = rules.merge_thresholds(project=settings.thresholds)
    include = settings.include_partial if settings.include_partial is not None else True
    result = analyze_files(files.read_files(spark, listed), limits, cache_folder).persist()
    found = rollups.explode_findings(result)
    summary = rollups.corpus_summary(result, rollups.file_mart(result), include)
    for kind in formats:
        path = out if out and len([f for f in formats if f != "table"]) == 1 else os.path.join(root, f"tessera-report.{kind}")
        if kind == "json":
            reports.write_json(result, summary, path, __version__)
        elif kind == "sarif":
            reports.write_sarif(found, path, __version__)
        elif kind == "html":
            reports.write_html(result, summary, rollups.debt_by_category(found), rollups.folder_scores(result), path)
        elif not quiet:
            for r in reports.table_rows(result).collect():
                print(f"{r['grade']} {r['score']:>3} {r['debt']:>12}  {r['path']}")
    if not quiet:
        print(reports.summary_line(summary))
    gate = settings.gate or config.Gate()
    if min_grade:
        gate.min_grade = min_grade.upper()
    if not use_gate or (settings.gate is None and not min_grade):
        return 0
    verdict = rollups.gate(rollups.corpus_score(result, include), rollups.fired_rules(found), gate.min_grade, gate.max_debt_ratio, gate.fail_on).first()
    for reason in verdict["reasons"]:
        print(f"gate: {reason}")
    return 0 if verdict["passed"] else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description="Quality of source files and texts.")
    parser.add_argument("-v", "--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan")
    s.add_argument("dir", nargs="?", default=".")
    s.add_argument("--format", default="table")
    s.add_argument("--out")
    s.add_argument("--min-grade")
    s.add_argument("--no-gate", action="store_true")
    s.add_argument("-q", "--quiet", action="store_true")
    s.add_argument("--cache", metavar="FOLDER", help="keep measurements by content there, and measure only what is new")
    i = commands.add_parser("init")
    i.add_argument("dir", nargs="?", default=".")
    args = parser.parse_args(argv)
    try:
        if args.command == "init":
            print(config.write_starter(args.dir))
            return 0
        formats = tuple(args.format.split(","))
        if bad := [f for f in formats if f not in FORMATS]:
            raise ValueError(f"no such format: {', '.join(bad)}")
        from tessera.session import session

        return scan(session(), os.path.abspath(args.dir), formats, args.out, args.min_grade, not args.no_gate, args.quiet, args.cache)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
