"""URL filters: host-suffix and path-prefix expressions, looked up by short hash prefixes.

Each distinct (host, path) is expanded into the expressions that a rule could have, an equi-join on the first
eight hex digits of their SHA-256 finds candidate rules, the full digests confirm them, and the longest rule
wins. Only pairs of a suffix size and a prefix length that occur in a rule are expanded, which loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as rows ``host, path, verdict``; a path begins with ``/`` or is empty."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def filter_urls(df: DataFrame, url: str, rules: DataFrame, into: str = "url_filter", default: str = "allow") -> DataFrame:
    """Adds a struct ``into`` with ``host, path, rule, verdict`` to every row of ``df``, in place of a column of
    that name. A rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest
    rule (host and path together) wins, among equal rules a block. No rule: ``rule`` is null, verdict ``default``.
    Null URLs and URLs without ``://`` have an empty host and path. Rows are neither lost nor merged, repeated
    rows included. Rules with a null in host, path or verdict are left out; without rules all get ``default``.
    """
    keyed = rules.dropna(subset=["host", "path", "verdict"]).select(
        F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"), F.translate("host", UPPER, LOWER).alias("h"), "path", "verdict"
    )
    best = keyed.groupBy("rule").agg(F.max(F.struct(F.col("verdict") == "block", "verdict")).getField("verdict").alias("verdict"))
    known = best.select("rule", "verdict", F.sha2("rule", 256).alias("digest"), F.substring(F.sha2("rule", 256), 1, 8).alias("prefix"))
    shapes = keyed.select(F.size(F.split("h", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().orderBy("labels", "chars").collect()
    longest = max((x.chars for x in shapes), default=0)

    # The caller's columns stay together in one struct, so no name of theirs can clash.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rows = rows.withColumn("start", F.substring("path", 1, longest))
    asked = rows.select(F.col("host").alias("_h"), F.col("start").alias("_p")).distinct()
    labels, chars = F.size(F.split("_h", r"\.")), F.length("_p")
    known_shapes = F.array(*[F.struct(F.lit(x.labels).alias("labels"), F.lit(x.chars).alias("chars")) for x in shapes]).cast("array<struct<labels:int,chars:int>>")
    fitting = F.filter(known_shapes, lambda x: (x.labels <= labels) & (x.chars <= chars))
    expressions = F.transform(fitting, lambda x: F.concat(F.call_function("substring_index", F.col("_h"), F.lit("."), -x.labels), F.substring(F.col("_p"), F.lit(1), x.chars)))
    asked = asked.select("_h", "_p", F.explode(expressions).alias("e"))
    asked = asked.select("_h", "_p", F.sha2("e", 256).alias("full"))
    asked = asked.withColumn("prefix", F.substring("full", 1, 8))
    found = asked.join(known, "prefix").where("full = digest")
    found = found.groupBy("_h", "_p").agg(F.max(F.struct(F.length("rule"), "rule", "verdict")).alias("_best"))
    found = written(found, "rules")  # a side of its own, so that a hot host can be split
    out = rows.join(found, (F.col("host") == F.col("_h")) & (F.col("start") == F.col("_p")), "left")
    judged = F.struct("host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    return out.select(*[judged.alias(into) if c == into else F.col("row").getField(c).alias(c) for c in dict.fromkeys([*df.columns, into])])
