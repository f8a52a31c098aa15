"""Greedy star clusters: a seed and all its neighbours, seeds in the order of their index.

The seeds are the lexicographically first maximal independent set, found in parallel rounds (Blelloch, Fineman, Shun,
"Greedy sequential maximal independent set and matching are parallel on average", SPAA 2012).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import file_name, is_official
from ..scratch import cut
from . import packed
from .blocks import weighted_sums
from .numbering import numbered


def linked(edges: DataFrame) -> DataFrame:
    """``a, part, near`` of edges ``i, j``."""
    both = edges.select(F.col("i").alias("a"), F.col("j").alias("b")).union(edges.select("j", "i"))
    return packed.links(both.select("a", F.shiftright("b", packed.PART).alias("part"), F.array("b").alias("near")))


def seeds(links: DataFrame) -> DataFrame:
    """links: ``a, part, near``, a written table. ``seed`` of every cluster. Lists are taken apart for seeds and, from the second
    round on, for what is still open."""
    open_ = cut(links.groupBy("a").agg(F.min(F.array_min("near")).alias("least")))
    lower, found = open_.where("least < a").select("a"), None
    while open_.head(1):
        new = cut(open_.join(lower, "a", "left_anti").select("a"))
        found = new if found is None else found.union(new)
        near = links.join(new, "a", "left_semi").select(F.explode("near").alias("a"))
        open_ = cut(open_.select("a").join(new.union(near), "a", "left_anti"))
        below = links.join(open_, "a", "left_semi").select("a", F.explode(F.filter("near", lambda b: b < F.col("a"))).alias("b"))
        lower = below.join(open_.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    found = links.select("a").where("false") if found is None else found
    return found.select(F.col("a").alias("seed"))


def members(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``cluster_id, file_index`` of edges ``i, j`` with i < j, as :func:`linked_members`."""
    return linked_members(linked(edges), of)


def linked_members(links: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``cluster_id, file_index``; a file may be in several clusters. Ids are dense in the order of the seeds.

    links: ``a, part, near``. of: ``file_index, rep, n``, where the links join the first files of equal sets; all files of a set are in
    its clusters then, and a set of several files that has no link is a cluster of its own."""
    links = cut(links)
    found = seeds(links)
    if of is not None:
        met = links.select(F.col("a").alias("rep"))
        found = found.union(of.where("n > 1 and file_index = rep").join(met, "rep", "left_anti").select(F.col("rep").alias("seed")))
    chosen = numbered(found, ["seed"], "cluster_id")
    near = links.join(chosen.withColumnRenamed("seed", "a"), "a").select("cluster_id", F.explode("near").alias("file_index"))
    near = near.union(chosen.select("cluster_id", F.col("seed").alias("file_index")))
    if of is not None:
        near = cut(near).withColumnRenamed("file_index", "rep").join(of.select("file_index", "rep"), "rep").select("cluster_id", "file_index")
    return cut(near)


def member_pairs(clusters: DataFrame, sets: DataFrame, of: DataFrame) -> DataFrame:
    """``cluster_id, file1_index, file2_index, similarity`` (unrounded) of all pairs inside a cluster; different sets (of: ``file_index,
    rep, n``) are compared in blocks, and only what comes out is written out for their files."""
    own = cut(clusters.join(of.select("file_index", "rep"), "file_index"))
    apart = packed.all_pairs(own.select(F.col("cluster_id").alias("key"), F.col("rep").cast("long").alias("id")).distinct(), sets).withColumnRenamed("key", "cluster_id")
    a, b = (own.select("cluster_id", F.col("rep").cast("long").alias(x), F.col("file_index").alias(f"f{x}")) for x in "ij")
    apart = apart.join(a, ["cluster_id", "i"]).join(b, ["cluster_id", "j"]).select("cluster_id", "fi", "fj", "jaccard")
    equal = a.join(b.withColumnRenamed("j", "i"), ["cluster_id", "i"]).where("fi < fj").select("cluster_id", "fi", "fj", F.lit(1.0).alias("jaccard"))
    return apart.unionByName(equal).select("cluster_id", F.least("fi", "fj").alias("file1_index"), F.greatest("fi", "fj").alias("file2_index"), F.col("jaccard").alias("similarity"))


def pair_means(clusters: DataFrame, sets: DataFrame, of: DataFrame) -> DataFrame:
    """``cluster_id, mean``: the mean similarity of all pairs of a cluster's files.

    Equal sets of a cluster (of: ``file_index, rep, n``) are one with a weight, and the pairs of different ones are added up in blocks;
    so no row stands for a pair, and a cluster of copies costs a row a file."""
    weights = cut(clusters.join(of.select("file_index", "rep"), "file_index").groupBy("cluster_id", "rep").agg(F.count("*").alias("w")))
    apart = weighted_sums(weights, sets)
    inside = weights.select("cluster_id", (F.col("w") * (F.col("w") - 1) / 2).alias("s"))
    size = weights.groupBy("cluster_id").agg(F.sum("w").alias("size"))
    sums = apart.unionByName(inside).groupBy("cluster_id").agg(F.sum("s").alias("s"))
    return sums.join(size, "cluster_id").select("cluster_id", (F.col("s") / (F.col("size") * (F.col("size") - 1) / 2)).alias("mean"))


def summary(clusters: DataFrame, means: DataFrame, files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``cluster_id, type, size, avg_similarity, has_official, marketplaces``."""
    about = files.select("file_index", "marketplace", is_official(F.col("marketplace"), config.official_prefixes).alias("official"))
    # by collection first: a large cluster of few collections is a few rows then
    part = clusters.join(about, "file_index").groupBy("cluster_id", "marketplace").agg(F.count("*").alias("n"), F.bool_or("official").alias("official"))
    rows = part.groupBy("cluster_id").agg(F.sum("n").alias("size"), F.bool_or("official").alias("has_official"), F.sort_array(F.collect_list("marketplace")).alias("marketplaces"))
    internal = F.size("marketplaces") == 1
    scaffold = internal & (F.col("size") >= config.scaffold_size) & (F.col("mean") >= config.scaffold_similarity)
    kind = F.when(scaffold, "scaffold").when(internal, "internal").otherwise("cross-marketplace")
    return rows.join(means, "cluster_id").select("cluster_id", kind.alias("type"), "size", F.bround("mean", 3).alias("avg_similarity"), "has_official", "marketplaces")


def file_index(files: DataFrame, clusters: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every file with the last cluster that holds it."""
    last = clusters.groupBy("file_index").agg(F.max("cluster_id").alias("cluster_id"))
    return files.join(last, "file_index", "left").select(
        "file_index", "marketplace", "plugin", F.col("relative_path").alias("path"), file_name(F.col("relative_path")).alias("filename"),
        is_official(F.col("marketplace"), config.official_prefixes).alias("is_official"), "cluster_id", F.col("cluster_id").isNotNull().alias("in_cluster"),
    )


def by_key(clusters: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """The inverted index of a file column: ``key, cluster_ids``."""
    return clusters.join(files, "file_index").groupBy(key).agg(F.sort_array(F.collect_set("cluster_id")).alias("cluster_ids"))
