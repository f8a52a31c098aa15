"""Comparisons of two collections and the checks on their outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..scratch import cut
from .similarity import best_pairs, indexed
from .stars import best_candidates


def best(baseline: DataFrame, target: DataFrame, config: Config = DEFAULT, banded: bool = False) -> DataFrame:
    """``j, jaccard, i``: each target file that has a match with its best one, the lowest index among equals. Exact matches over
    sets (``file_index, sh``), or candidates over signatures (``file_index, sig`` as bytes) with their estimates."""
    if banded:
        return best_candidates(baseline, target, config)
    return best_pairs(baseline, target, config.threshold)


def _written(banded: bool, *sides: DataFrame) -> list[DataFrame]:
    """Signatures are read several times, so they are worked out once; sets are made anew where they are read."""
    return [cut(x) if banded else x for x in sides]


def _indexed(files: DataFrame, banded: bool) -> DataFrame:
    """The files that can match at all; those without shingles have no signature."""
    return files if banded else indexed(files)


def best_matches(target: DataFrame, baseline: DataFrame, config: Config = DEFAULT, banded: bool = False) -> DataFrame:
    """Every target file with its most similar baseline file (the lowest index among equals) and its status. A candidate
    whose estimate is below the threshold leaves its file novel."""
    target, baseline = _written(banded, target, baseline)
    rows = _indexed(target, banded).join(best(baseline, target, config, banded), F.col("file_index") == F.col("j"), "left")
    s = F.col("jaccard")
    status = F.when(s >= config.redundant, "redundant").when(s >= config.threshold, "partial").otherwise("novel")
    known = s >= config.threshold
    return rows.select("file_index", status.alias("status"), F.when(known, F.bround(s, 2)).alias("similarity"), F.when(known, F.col("i")).alias("similar_to"))


def sanity(total: Column, novel: Column, redundant: Column, clusters: Column) -> Column:
    """``confidence`` and ``warnings`` (their kinds) of an outcome."""
    ratio, fresh = redundant / F.nullif(total, F.lit(0)), novel / F.nullif(total, F.lit(0))
    zero = total == 0
    rules = [
        ("no files", zero), ("zero membership", ~zero & (clusters > 1000) & (redundant == 0)),
        ("low ratio", ~zero & (total > 500) & (ratio < 0.05)), ("high ratio", ~zero & (total > 500) & (ratio > 0.95)),
        ("even split", ~zero & (total > 100) & fresh.between(0.48, 0.52) & ratio.between(0.48, 0.52)),
    ]
    warnings = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    confidence = F.when(zero, "none").when(rules[1][1], "low").when(rules[2][1] | rules[3][1] | rules[4][1], "medium").otherwise("high")
    return F.struct(confidence.alias("confidence"), warnings.alias("warnings"))


def totals(matches: DataFrame, clusters: int = 0) -> DataFrame:
    """Counts by status, the outcome's sanity and the comparison's and the impact's verdicts."""
    n = matches.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("novel", "partial", "redundant")])
    check = sanity(F.col("total"), F.col("novel"), F.col("redundant"), F.lit(clusters))
    ratio = F.col("redundant") / F.nullif(F.col("total"), F.lit(0))
    verdict = F.when(ratio > 0.5, "high").when(ratio > 0.2, "some").otherwise("low")
    # impact counts partial files as novel
    fresh = F.col("novel") + F.col("partial")
    impact = F.when(ratio > 0.5, "high").when(fresh > F.col("redundant"), "mostly new").otherwise("mixed")
    return n.select("total", "novel", "partial", "redundant", check.getField("confidence").alias("confidence"), check.getField("warnings").alias("warnings"), verdict.alias("verdict"), fresh.alias("impact_novel"), impact.alias("impact"))


def venn(a: DataFrame, b: DataFrame, config: Config = DEFAULT, banded: bool = False) -> DataFrame:
    """Shared and unique files of two collections: B-side files with a match are shared, A-side files that are nobody's
    best match are unique; ``shared_a`` counts A-side files that are someone's. ``banded``: see :func:`best`; a candidate counts
    as a match whatever its estimate."""
    a, b = _written(banded, a, b)
    hit = best(a, b, config, banded).agg(F.count("*").alias("shared"), F.count_distinct("i").alias("shared_a"))
    sizes = [_indexed(x, banded).agg(F.count("*").alias(n)) for x, n in ((a, "total_a"), (b, "total_b"))]
    one = hit.crossJoin(sizes[0]).crossJoin(sizes[1])  # one row each
    percent = lambda n, d: F.coalesce(F.bround(100.0 * F.col(n) / F.nullif(F.col(d), F.lit(0)), 1), F.lit(0.0))
    empty = (F.col("total_a") == 0) | (F.col("total_b") == 0)
    identical = (F.col("shared") == F.col("total_b")) & (F.col("shared_a") == F.col("total_a"))
    verdict = F.when(empty, "empty").when(F.col("shared") == 0, "disjoint").when(identical, "identical").otherwise("partial")
    unique = [(F.col(f"total_{x}") - F.col(n)).alias(f"unique_{x}") for x, n in (("a", "shared_a"), ("b", "shared"))]
    overlap = [percent("shared", f"total_{x}").alias(f"overlap_{x}") for x in "ab"]
    return one.select("total_a", "total_b", "shared", "shared_a", *unique, *overlap, verdict.alias("verdict"))


def matched_pairs(a: DataFrame, b: DataFrame, files: DataFrame, config: Config = DEFAULT, banded: bool = False) -> DataFrame:
    """``file_a, file_b, similarity`` of the best matches, as paths, most similar first."""
    path = files.select("file_index", "relative_path")
    rows = best(*_written(banded, a, b), config, banded)
    rows = rows.join(path.select(F.col("file_index").alias("i"), F.col("relative_path").alias("file_a")), "i").join(path.select(F.col("file_index").alias("j"), F.col("relative_path").alias("file_b")), "j")
    return rows.select("file_a", "file_b", F.bround("jaccard", 3).alias("similarity")).orderBy(F.desc("similarity"), "file_a", "file_b")


def redundant(matches: DataFrame, target: DataFrame, baseline: DataFrame, most: int = 10) -> DataFrame:
    """The most similar redundant files, with what they are similar to: ``file, similarity, similar_to`` (location)."""
    location = F.concat_ws("/", "marketplace", "plugin", "relative_path")
    mine = target.select("file_index", F.col("relative_path").alias("file"))
    theirs = baseline.select(F.col("file_index").alias("similar_to"), location.alias("location"))
    rows = matches.where("status = 'redundant'").join(mine, "file_index").join(theirs, "similar_to", "left")
    return rows.select("file", "similarity", F.col("location").alias("similar_to")).orderBy(F.desc("similarity"), "file").limit(most)
