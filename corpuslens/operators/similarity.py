"""Similarity joins over shingle sets: whole by prefix filtering, approximate by banded MinHash."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import kernels
from ..functions.text import estimate, signature
from ..scratch import cut
from . import packed


def with_shingles(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``file_index, sh, key`` of the files that are long enough: the shingles as 64-bit numbers, and 128 bits that equal sets share.

    Two different shingles have one number with a probability of 2^-64, so of two sets that are compared a million pairs of
    members give a wrong similarity in one of 10^13 cases."""
    return kernels.hashed_sets(files, config)


def _hashed(sets: DataFrame) -> DataFrame:
    """Sets in that form; of sets of strings the numbers are hashes."""
    if "key" in sets.columns:
        return sets
    key = F.unhex(F.md5(F.array_join(F.array_sort("sh"), "\n")))
    return sets.select("file_index", F.transform("sh", lambda s: F.xxhash64(s)).alias("sh"), key.alias("key"))


def collapsed(sets: DataFrame) -> DataFrame:
    """``file_index, rep, n``: every file with a shingle, the first file that has the same set, and how many have it. Written."""
    return counted(sets)[0]


def counted(sets: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """:func:`collapsed` and the counters of the sets' members, of one pass over the texts; kept with the frame for the next time."""
    known = getattr(sets, "counted", None)
    if known is None:
        keyed, counts = kernels.keyed_counts(_hashed(sets))
        first = cut(keyed.groupBy("key").agg(F.min("file_index").alias("rep"), F.count("*").alias("n")))
        known = sets.counted = cut(keyed.join(first, "key").select("file_index", "rep", "n")), counts
    return known


def indexed(sets: DataFrame) -> DataFrame:
    """``file_index`` of the files that have a shingle."""
    return collapsed(sets).select("file_index")


def _firsts(of: DataFrame) -> DataFrame:
    """The first file of each different set."""
    return of.where("file_index = rep").select("file_index")


def class_edges(sets: DataFrame, of: DataFrame, threshold: float = DEFAULT.threshold, counts: np.ndarray | None = None) -> DataFrame:
    """Similar pairs of different sets, under the first files that have them, exactly.

    Only rare members take part in the join (a lossless filter). A candidate is dropped if the sizes, or what is left of both
    sets after the place of the shared member, rule the threshold out; what remains is verified on the whole sets."""
    own, firsts = _hashed(sets), _firsts(of)
    counts = kernels.bucket_counts(own) if counts is None else counts
    return packed.pairs([own], counts, threshold, [firsts], [kernels.marks(firsts)]).distinct()


def class_links(sets: DataFrame, of: DataFrame, threshold: float = DEFAULT.threshold, counts: np.ndarray | None = None) -> DataFrame:
    """The same as ``a, part, near``: what each is linked to, in lists, so that a group of near copies writes eight bytes a link."""
    own, firsts = _hashed(sets), _firsts(of)
    counts = kernels.bucket_counts(own) if counts is None else counts
    return packed.pairs([own], counts, threshold, [firsts], [kernels.marks(firsts)], linked=True)


def similar_pairs(sets: DataFrame, threshold: float = DEFAULT.threshold) -> DataFrame:
    """``i, j, jaccard`` of all pairs of files, i < j: pairs of different sets, and of the files of equal ones, written out."""
    of, counts = counted(sets)
    edges = class_edges(sets, of, threshold, counts)
    a, b = of.select(F.col("rep").alias("ra"), F.col("file_index").alias("fa")), of.select(F.col("rep").alias("rb"), F.col("file_index").alias("fb"))
    apart = edges.withColumnsRenamed({"i": "ra", "j": "rb"}).join(a, "ra").join(b, "rb").select(F.least("fa", "fb").alias("i"), F.greatest("fa", "fb").alias("j"), "jaccard")
    several = of.where("n > 1").select("rep", "file_index")
    equal = several.withColumnRenamed("file_index", "i").join(several.withColumnRenamed("file_index", "j"), "rep").where("i < j").select("i", "j", F.lit(1.0).alias("jaccard"))
    return apart.unionByName(equal)


def count_pairs(sets: DataFrame, threshold: float = DEFAULT.threshold) -> int:
    """How many rows :func:`similar_pairs` has, without those rows."""
    of, counts = counted(sets)
    n = of.where("file_index = rep").select("rep", "n")
    edges = class_edges(sets, of, threshold, counts).join(n.toDF("i", "ni"), "i").join(n.toDF("j", "nj"), "j")
    apart, equal = edges.agg(F.sum(F.col("ni") * F.col("nj"))).first()[0], n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    return int(apart or 0) + int(equal or 0)


def best_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``j, jaccard, i``: for each right file its most similar left file at or above the threshold, the first among equals."""
    (of_left, counts), (of_right, more) = counted(left), counted(right)
    sides, firsts = [_hashed(left), _hashed(right)], [_firsts(of_left), _firsts(of_right)]
    pairs = packed.pairs(sides, counts + more, threshold, firsts, [kernels.marks(x) for x in firsts], best=True)
    best = pairs.groupBy("j").agg(F.max(F.struct("jaccard", (-F.col("i")).alias("least"))).alias("m"))
    own = of_right.select(F.col("file_index").alias("file"), F.col("rep").alias("j"))
    return own.join(best, "j").select(F.col("file").alias("j"), F.col("m.jaccard").alias("jaccard"), (-F.col("m.least")).alias("i"))


def signatures(sets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return sets.where("size(sh) > 0").select("file_index", signature(F.col("sh"), config.slots).alias("sig"))


def banded_pairs(sigs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``i, j, estimate`` of the pairs that agree in a whole band of their signatures; candidates, not verified."""
    sigs = cut(sigs)
    band = F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("sig", k * config.rows + 1, F.lit(config.rows)), ",").alias("v")))
    rows = sigs.select("file_index", F.explode(band).alias("b")).select("file_index", "b.k", "b.v")
    met = rows.alias("x").join(rows.alias("y"), ["k", "v"]).where("x.file_index < y.file_index").select(F.col("x.file_index").alias("i"), F.col("y.file_index").alias("j")).distinct()
    a, b = sigs.select(F.col("file_index").alias("i"), F.col("sig").alias("a")), sigs.select(F.col("file_index").alias("j"), F.col("sig").alias("b"))
    return met.join(a, "i").join(b, "j").select("i", "j", estimate(F.col("a"), F.col("b"), config.slots).alias("estimate"))
