"""Questions to a cluster index: where a file lives, statistics, overlaps of collections, and capability search."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import search_score
from .numbering import numbered


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression for the whole string."""
    text = fnmatch.translate(pattern)
    return "\\A" + (text[: -len("\\Z")] if text.endswith("\\Z") else text.removesuffix("\\z")) + "\\z"


def lookup_part(filename: Column, parts: int) -> Column:
    """The part of a saved index that holds a file name."""
    return F.pmod(F.xxhash64(filename), F.lit(parts))


def named(located: DataFrame, query: str, config: Config = DEFAULT) -> DataFrame:
    """Locations of the files with the name that the query ends in (after its last slash). Of a saved index one part is read, and
    of that the row groups whose statistics and Bloom filters admit the name."""
    name = query.rsplit("/", 1)[-1]
    hit = located.where(F.col("filename") == name)
    return hit.where(F.col("part") == lookup_part(F.lit(name), config.lookup_parts)) if "part" in located.columns else hit


def where(located: DataFrame, query: str, config: Config = DEFAULT) -> DataFrame:
    """Locations (``filename, cluster_id, ...``) of the files that :func:`named` finds; if there is none, of the clusters that hold
    a file that matches the pattern or holds a match, and of those the locations whose name matches or holds the query. A
    saved index has the names in lower case already, as ``folded``."""
    saved = [c for c in ("part", "folded") if c in located.columns]
    hit = named(located, query, config)
    if hit.head(1):
        return hit.drop(*saved)
    name = F.col("filename")
    folded = F.col("folded") if "folded" in located.columns else F.lower(name)
    first = located.where(name.rlike(glob_regex(query)) | name.rlike(glob_regex(f"*{query}*"))).select("cluster_id").distinct()
    return located.join(first, "cluster_id", "left_semi").where(name.rlike(glob_regex(query)) | F.contains(folded, F.lit(query.lower()))).drop(*saved)


def type_counts(located: DataFrame) -> DataFrame:
    """Clusters and their files by type, of locations that carry their cluster's type."""
    return located.groupBy("type").agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("files")).orderBy("type")


def filename_counts(located: DataFrame, most: int = 10) -> DataFrame:
    return located.groupBy("filename").agg(F.count_distinct("cluster_id").alias("clusters")).orderBy(F.desc("clusters"), "filename").limit(most)


def collection_counts(located: DataFrame, most: int | None = None) -> DataFrame:
    rows = located.groupBy("marketplace").agg(F.count("*").alias("files"), F.count_distinct("cluster_id").alias("clusters")).orderBy(F.desc("files"), "marketplace")
    return rows if most is None else rows.limit(most)


def overlap_matrix(located: DataFrame) -> DataFrame:
    """Jaccard of the cluster sets of each two collections, zeros included; one row a pair of collections, a table that is
    small because collections are few."""
    own = located.select("marketplace", "cluster_id").distinct()
    sizes = own.groupBy("marketplace").agg(F.count("*").alias("n"))
    a, b = own.withColumnRenamed("marketplace", "mp_a"), own.withColumnRenamed("marketplace", "mp_b")
    both = a.join(b, "cluster_id").groupBy("mp_a", "mp_b").agg(F.count("*").alias("k"))
    x, y = sizes.select(F.col("marketplace").alias("mp_a"), F.col("n").alias("na")), sizes.select(F.col("marketplace").alias("mp_b"), F.col("n").alias("nb"))
    k = F.coalesce("k", F.lit(0))
    return x.crossJoin(y).join(both, ["mp_a", "mp_b"], "left").select("mp_a", "mp_b", F.bround(k / (F.col("na") + F.col("nb") - k), 3).alias("similarity"))


def top_overlaps(matrix: DataFrame, most: int = 20) -> DataFrame:
    return matrix.where("mp_a < mp_b and similarity > 0").orderBy(F.desc("similarity"), "mp_a", "mp_b").limit(most)


def heat(similarity: Column) -> Column:
    """The glyph of a similarity in a heat map."""
    return F.when(similarity >= 0.8, "█").when(similarity >= 0.5, "▓").when(similarity >= 0.2, "▒").when(similarity > 0, "░").otherwise("·")


def heat_map(located: DataFrame, most: int = 12) -> DataFrame:
    """The first collections by name against each other: ``place, marketplace`` and the glyphs ``c1`` to ``c<most>`` of the overlaps
    with the collection of that place, blank beyond the last. One row a collection, ``most`` at most."""
    head = located.select("marketplace").distinct().orderBy("marketplace").limit(most)
    head = numbered(head, ["marketplace"], "k").withColumn("place", F.col("k") + 1).drop("k")
    cells = overlap_matrix(located.join(head.select("marketplace"), "marketplace", "left_semi"))
    own = head.select(F.col("marketplace").alias("mp_a"), F.col("place").alias("row"))
    other = head.select(F.col("marketplace").alias("mp_b"), F.col("place").alias("column"))
    rows = cells.join(own, "mp_a").join(other, "mp_b").groupBy(F.col("row").alias("place"), F.col("mp_a").alias("marketplace"))
    wide = rows.pivot("column", list(range(1, most + 1))).agg(F.first(heat(F.col("similarity"))))
    names = [F.coalesce(F.col(f"`{k}`"), F.lit(" ")).alias(f"c{k}") for k in range(1, most + 1)]
    return wide.select("place", "marketplace", *names).orderBy("place")


def find(capabilities: DataFrame, query: str, most: int = 30) -> DataFrame:
    """The best matches by lexical score; ties in the order of ``ord``."""
    score = search_score(F.lit(query), F.col("name"), F.col("description"), F.col("triggers"))
    scored = capabilities.withColumn("score", score)
    return (scored if not query else scored.where("score > 0")).orderBy(F.desc("score"), "ord").limit(most)


def grouped(found: DataFrame) -> DataFrame:
    """Matches by collection, each list in the order of scores."""
    place = found.withColumn("place", F.row_number().over(Window.partitionBy("marketplace").orderBy(F.desc("score"), "ord")))
    return place.groupBy("marketplace").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))


def installed_groups(plugins: DataFrame) -> DataFrame:
    """Installed plugins by collection: how many, and their names in order."""
    return plugins.groupBy("marketplace").agg(F.count("*").alias("plugins"), F.sort_array(F.collect_set("name")).alias("names")).orderBy("marketplace")


def capability_totals(capabilities: DataFrame) -> DataFrame:
    return capabilities.groupBy("kind").agg(F.count("*").alias("capabilities")).orderBy("kind")
