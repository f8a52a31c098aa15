"""Commands over a folder of collections: scan, where, compare-marketplaces, compare, impact, installed, find, stats,
marketplace-level, checkout, describe and diff. Results are printed as lines of JSON, or as text."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels
from .functions import text as T
from .functions.pandas_udfs import front_matter
from .operators import compare, diffing, index, similarity
from .plans.scan import Scan
from .scratch import cut
from .sinks import exports, render
from .sources import files as source
from .sources import lookup


def _listed(meta: Column, path: str) -> Column:
    """A field of the front matter as an array: a list as it is, a scalar as one, nothing as none."""
    one = F.get_json_object(meta, path)
    return F.coalesce(F.from_json(one, "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def describe(files: DataFrame) -> DataFrame:
    """Names, triggers, dependencies, tools and complexity of skill files."""
    c, meta = F.col("content"), F.col("frontmatter")
    rows = files.withColumn("frontmatter", front_matter("content"))
    counted = {"line_count": F.size(T.lines(c)), "word_count": T.word_count(c), "tool_uses": T.tools(c), "dependencies": T.dependencies(c)}
    rows = rows.withColumns(counted)
    stem = F.regexp_replace(T.file_name(F.col("relative_path")), r"\.md$", "")
    described = F.nullif(F.array_join(_listed(meta, "$.description"), " "), F.lit(""))
    return rows.select(
        F.coalesce(F.get_json_object(meta, "$.name"), stem).alias("name"),
        F.when(F.contains("relative_path", F.lit("agents")), "agent").otherwise("skill").alias("kind"),
        "marketplace", "plugin", F.col("relative_path").alias("path"),
        F.coalesce(described, T.description_of(c, 300, 20)).alias("description"),
        F.slice(F.concat(_listed(meta, "$.triggers"), T.triggers(c)), 1, 5).alias("triggers"),
        "dependencies", "tool_uses", "line_count", "word_count",
        T.complexity(F.col("line_count"), F.col("word_count"), F.size("tool_uses")).alias("complexity_score"),
        (meta != "{}").alias("has_frontmatter"), "frontmatter",
    )


COMMANDS = {
    "scan": [], "where": ["query"], "compare-marketplaces": [], "compare": ["target"], "impact": ["target"], "installed": [], "find": ["query"],
    "stats": [], "marketplace-level": [], "checkout": ["skill"], "describe": ["skill"], "diff": ["a", "b"],
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("corpuslens")
    p.add_argument("--root", default=str(Path.home() / ".claude/plugins/marketplaces"))
    p.add_argument("--data", default="corpuslens-data")
    p.add_argument("--installed-file", default=str(Path.home() / ".claude/plugins/installed_plugins.json"))
    sub = p.add_subparsers(dest="command")
    for name, arguments in COMMANDS.items():
        s = sub.add_parser(name)
        for a in arguments:
            s.add_argument(a)
        if name in ("scan", "compare", "impact", "compare-marketplaces"):
            s.add_argument("--banded", action="store_true", help="candidates by signatures with estimates, in place of exact similarities")
        if name in ("compare", "impact"):
            s.add_argument("--baseline", "-b", default="installed")
        if name in ("compare", "impact", "compare-marketplaces"):
            s.add_argument("--saved", action="store_true", help="with --banded: the signatures of the last scan, no file is read")
        if name == "compare-marketplaces":
            s.add_argument("--marketplace-a", "-a", required=True)
            s.add_argument("--marketplace-b", "-b", required=True)
        if name == "checkout":
            s.add_argument("--dir", "-d", default=".")
            s.add_argument("--flat", "-f", action="store_true")
        if name in ("where", "stats", "marketplace-level", "compare", "impact"):
            s.add_argument("--report", help="a saved report of either version; else what scan left in --data")
        if name == "diff":
            s.add_argument("--context", type=int, default=3)
        s.add_argument("--json", action="store_true", help="lines of JSON, which is the default")
        s.add_argument("--text", action="store_true", help="text for a terminal")
        s.add_argument("--verbose", "-v", action="store_true")
        s.add_argument("--heatmap", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    p = _parser()
    args = p.parse_args(argv)
    if not args.command:
        p.print_help()
        return 0
    spark = SparkSession.builder.appName("corpuslens").getOrCreate()
    show = lambda df: [print(line) for line in df.toJSON().toLocalIterator()]
    try:
        return _run(spark, args, show)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


def _say(lines: Iterable[str]) -> None:
    print("\n".join(lines))


def _found(rows: DataFrame, args: argparse.Namespace, show) -> None:  # noqa: ANN001
    if args.text:
        _say(render.found(rows.collect()))  # 30 at most
    else:
        show(index.grouped(rows) if args.verbose else rows)


def _saved(spark: SparkSession, args: argparse.Namespace, show) -> bool:  # noqa: ANN001
    """Answers what the saved index or the installed plugins can answer; no file of a collection is read."""
    if args.command == "installed":
        plugins = source.installed_plugins(spark, args.installed_file)
        groups = index.installed_groups(plugins)
        if args.text:
            _say(render.installed(groups.toLocalIterator()))
        else:
            show(plugins.orderBy("marketplace", "name") if args.verbose else groups)
    elif args.command == "where":
        places = index.where(source.located(spark, args.report, args.data), args.query)
        if args.text and not args.report:
            clusters = spark.read.parquet(f"{args.data}/clusters").join(places.select("cluster_id").distinct(), "cluster_id", "left_semi")
            _say(render.where(clusters.collect(), places.collect()))
        else:
            show(places)
    elif args.command == "stats":
        places = source.located(spark, args.report, args.data)
        show(index.type_counts(places))
        show(index.filename_counts(places))
    elif args.command == "marketplace-level":
        places = source.located(spark, args.report, args.data)
        counts, pairs = index.collection_counts(places, None if args.verbose else 15), index.top_overlaps(index.overlap_matrix(places))
        heat = index.heat_map(places) if args.heatmap else None
        if args.text:
            first = pairs.collect()
            _say(render.level(counts.collect(), places.select("marketplace").distinct().count(), first[:15], len(first), heat and heat.collect()))
            return True
        for df in (counts, pairs, heat):
            if df is not None:
                show(df)
    elif args.command == "find" and source.exists(spark, f"{args.data}/capabilities"):
        _found(index.find(source.capability_index(spark, f"{args.data}/capabilities"), args.query), args, show)
    elif args.command in ("compare", "impact", "compare-marketplaces") and args.banded and args.saved:
        _compared(spark, args, show, source.signed(spark, args.data), lambda files: files.select("file_index", "sig"), None)
    else:
        return False
    return True


def _compared(spark: SparkSession, args: argparse.Namespace, show, files: DataFrame, prepared, installed: DataFrame | None) -> None:  # noqa: ANN001
    """The commands that compare: ``prepared`` makes of files what is compared, sets or signatures."""
    if args.command == "compare-marketplaces":
        sides = [source.baseline(files, m) for m in (args.marketplace_a, args.marketplace_b)]
        a, b = (cut(prepared(x)) for x in sides)
        pairs = compare.matched_pairs(a, b, files.select("file_index", "relative_path"), banded=args.banded)
        if args.text:
            v = compare.venn(a, b, banded=args.banded).first()
            _say(render.venn(v, args.marketplace_a, args.marketplace_b, pairs.limit(10).collect(), v.shared))
            return
        show(compare.venn(a, b, banded=args.banded))
        show(pairs if args.verbose else pairs.limit(10))
        return
    target, base = source.baseline(files, args.target), source.baseline(files, args.baseline, installed)
    matches = cut(compare.best_matches(cut(prepared(target)), cut(prepared(base)), banded=args.banded))
    totals = compare.totals(matches, source.cluster_count(spark, args.report, args.data))
    if args.text:
        first = compare.redundant(matches, target, base).collect() if args.verbose else None
        _say(render.compared(totals.first(), args.target, args.baseline, first))
        return
    show(totals)
    if args.verbose:
        show(compare.redundant(matches, target, base))


def _run(spark: SparkSession, args: argparse.Namespace, show) -> int:  # noqa: ANN001
    if _saved(spark, args, show):
        return 0
    scanned = source.scan_tree(spark, args.root)
    files = scanned.files
    if args.command == "scan":
        scan = Scan(files, banded=args.banded)
        exports.write_tables(scan, args.data)
        exports.report(scan).coalesce(1).write.mode("overwrite").text(f"{args.data}/report")
        exports.capability_report(source.capabilities(files)).coalesce(1).write.mode("overwrite").text(f"{args.data}/capabilities")
        show(scan.summary())
        print(json.dumps(scanned.counts))
        show(scanned.problems)
    elif args.command in ("compare-marketplaces", "compare", "impact"):
        installed = None
        if source.exists(spark, args.installed_file):
            installed = source.scan_installed(spark, source.installed_plugins(spark, args.installed_file)).files
            installed = installed.withColumn("file_index", F.col("file_index") + (1 << 40))  # apart from those of the root
        signed = lambda x: kernels.signatures(x, raw=True)
        _compared(spark, args, show, files, signed if args.banded else similarity.with_shingles, installed)
    elif args.command == "find":
        found = source.capabilities(files).withColumn("ord", F.concat_ws("/", "marketplace", "path"))
        _found(index.find(found, args.query), args, show)
    elif args.command == "diff":
        ids = [_skill(files, x).select("file_index").first() for x in (args.a, args.b)]
        if None in ids:
            raise ValueError("not found")
        pair = spark.createDataFrame([(ids[0][0], ids[1][0])], "i long, j long")
        print(diffing.terminal(diffing.diff_pairs(pair, files, args.context).first().unified_diff))
    elif args.command == "describe":
        row = _skill(files, args.skill)
        if not row.head(1):
            raise ValueError(f"not found: {args.skill}")
        about = describe(row)
        if args.text:
            r = about.first()
            _say(render.skill(r, json.loads(r.frontmatter) if args.verbose else None))
        else:
            show(about)
    else:
        found = lookup.skill_to_copy(files, args.skill).first()
        if found is None:
            raise ValueError(f"not found: {args.skill}")
        path = f"{args.root.removeprefix('file:').rstrip('/')}/{found.marketplace}/{found.path}"
        result = exports.checkout(path, args.dir, not args.flat)
        print(result["message"])
        return 0 if result["success"] else 1
    return 0


def _skill(files: DataFrame, spec: str) -> DataFrame:
    """The file of a skill by its candidates, else by its folder's name."""
    row = lookup.skill_file(files, spec)
    return row if row.head(1) else source.find_file(files, spec)


if __name__ == "__main__":
    sys.exit(main())
