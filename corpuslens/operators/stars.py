"""Clusters and comparisons over banded signatures: two files are neighbours if a whole band of their signatures agrees.

Candidates are taken as they are, unverified. Nothing here lists the pairs of a band's files: a bucket (a band and its
values) stands for all of them, so the work grows with the number of files, however many of them are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..scratch import cut
from .blocks import sorted_groups
from .numbering import numbered

#: Files of a bucket's side that are compared with another side's at once.
BLOCK = 512


def buckets(sigs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``node, bucket`` for each band of each signature (``file_index, sig`` as bytes)."""
    width = 4 * config.rows
    band = F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), lambda k: F.concat(F.unhex(F.lpad(F.hex(k), 2, "0")), F.substring("sig", k * width + 1, F.lit(width))))
    return sigs.select(F.col("file_index").alias("node"), F.explode(band).alias("bucket"))


def shared(rows: DataFrame) -> DataFrame:
    """The rows of buckets with several files. Written: they are read again and again."""
    rows = cut(rows)
    many = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    return cut(rows.join(many, "bucket"))


def seeds(rows: DataFrame) -> DataFrame:
    """``seed``: going through the files in order, each that shares no bucket with a seed before it.

    In rounds: a file that is the least open one in all its buckets is a seed, and the files of its buckets are closed. A
    bucket holds one seed at most, so a round is two aggregations and two joins by bucket."""
    found, open_ = None, rows
    while open_.head(1):
        low = cut(open_.groupBy("bucket").agg(F.min("node").alias("low")))
        new = open_.join(low, "bucket").groupBy("node").agg(F.bool_and(F.col("node") == F.col("low")).alias("least")).where("least").select("node")
        new = cut(new)
        found = new if found is None else found.union(new)
        taken = low.join(new.withColumnRenamed("node", "low"), "low", "left_semi").select("bucket")
        closed = cut(rows.join(taken, "bucket", "left_semi").select("node").distinct())
        open_ = cut(open_.join(closed, "node", "left_anti"))
    found = rows.select("node").where("false") if found is None else found
    return found.select(F.col("node").alias("seed"))


def stars(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``seed, node``: every seed with all files of its buckets, itself too; a file may have several seeds."""
    own = rows.join(chosen.withColumnRenamed("seed", "node"), "node", "left_semi").select("bucket", F.col("node").alias("seed"))
    return rows.join(cut(own), "bucket").select("seed", "node").distinct()


def members(sigs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``cluster_id, file_index``; ids are dense in the order of the seeds."""
    rows = shared(buckets(sigs, config))
    chosen = numbered(seeds(rows), ["seed"], "cluster_id")
    near = stars(rows, chosen.select("seed"))
    return cut(near.join(chosen, "seed").select("cluster_id", F.col("node").alias("file_index")))


def slot_means(clusters: DataFrame, sigs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``cluster_id, mean``: the mean estimate of all pairs of a cluster's files, without pairs: c files that agree in a slot
    are c (c - 1) / 2 pairs that do."""
    slot = F.transform(F.sequence(F.lit(0), F.lit(config.slots - 1)), lambda k: F.substring("sig", k * 4 + 1, F.lit(4)))
    values = clusters.join(sigs, "file_index").select("cluster_id", F.posexplode(slot).alias("slot", "value"))
    alike = values.groupBy("cluster_id", "slot", "value").agg(F.count("*").alias("c"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    sums = alike.groupBy("cluster_id").agg(F.sum(pairs("c")).alias("equal"), F.sum(F.when(F.col("slot") == 0, F.col("c"))).alias("size"))
    return sums.select("cluster_id", (F.col("equal") / F.lit(float(config.slots)) / pairs("size")).alias("mean"))


def _estimated(slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of every two blocks of a cluster, with the share of slots that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            cluster, i, j, equal = (np.concatenate(x) for x in zip(*held, strict=True))
            columns = [pa.array(cluster), pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(equal / float(slots))]
            return pa.RecordBatch.from_arrays(columns, ["cluster_id", "file1_index", "file2_index", "similarity"])

        for (cluster, one, two), group in sorted_groups(batches, ("cluster_id", "one", "two")):
            ids, block = group.column("file_index").to_numpy(), group.column("block").to_numpy()
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u4").reshape(len(ids), -1)
            first, second = np.flatnonzero(block == one), np.flatnonzero(block == two)
            theirs, y = ids[second], np.ascontiguousarray(sigs[second].T)
            for k, at in enumerate(first.tolist()):
                start = k + 1 if one == two else 0
                j = theirs[start:]
                if not len(j):
                    continue
                equal = (y[:, start:] == sigs[at][:, None]).sum(axis=0)
                held.append((np.full(len(j), cluster, np.int64), np.full(len(j), ids[at], np.int64), j, equal))
                size += len(j)
                if size >= 1 << 16:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    return run


def member_pairs(clusters: DataFrame, sigs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``cluster_id, file1_index, file2_index, similarity`` (estimated) of all pairs inside a cluster, where they are asked for. Files are
    compared in blocks, every two of which meet in a task."""
    n = clusters.groupBy("cluster_id").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    rows = clusters.join(n, "cluster_id").withColumn("block", F.pmod(F.xxhash64("file_index"), F.col("blocks")))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("one"), F.greatest(x, "block").alias("two")))
    rows = rows.withColumn("m", F.explode(meet)).select("cluster_id", "m.one", "m.two", "block", "file_index")
    rows = rows.join(sigs, "file_index").select("cluster_id", "one", "two", "block", F.col("file_index").cast("long").alias("file_index"), "sig")
    rows = rows.repartition("cluster_id", "one", "two").sortWithinPartitions("cluster_id", "one", "two")
    return rows.mapInArrow(_estimated(config.slots), "cluster_id long, file1_index long, file2_index long, similarity double")


def _classes(sigs: DataFrame) -> DataFrame:
    """``sig, least``: each signature once, with the first of its files."""
    return sigs.groupBy("sig").agg(F.min("file_index").alias("least"))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each right file of a block the left file with most equal slots, the first among equals."""
    out: list[tuple[int, int, int]] = []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["j", "equal", "i"])

    for _, group in sorted_groups(batches, ("bucket", "one", "two")):
        right = group.column("right").to_numpy()
        ids = group.column("node").to_numpy()
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u4").reshape(len(ids), -1)
        order = np.argsort(ids[~right], kind="stable")
        a, x = ids[~right][order], sigs[~right][order]
        b, y = ids[right], sigs[right]
        if not len(a) or not len(b):
            continue
        equal = np.zeros((len(b), len(a)), np.int32)
        for k in range(x.shape[1]):
            equal += y[:, k, None] == x[None, :, k]
        best = equal.argmax(axis=1)
        out += zip(b.tolist(), equal[np.arange(len(b)), best].tolist(), a[best].tolist(), strict=True)
        if len(out) > 10_000:
            yield batch_of()
    yield batch_of()


def best_candidates(left: DataFrame, right: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``j, jaccard, i``: for every right file that shares a bucket with a left one the left file with the highest estimate (the
    first among equals). left, right: ``file_index, sig`` as bytes, written tables: they are read several times.

    Equal signatures are found by themselves and count once; of the others each bucket's files are compared in blocks,
    which write a row for each right file, bucket and left block, never one for a pair."""
    a, b = cut(_classes(left)), cut(_classes(right))
    same = cut(b.join(a.withColumnRenamed("least", "i"), "sig").select("sig", F.lit(config.slots).cast("long").alias("equal"), "i"))
    rest = b.join(same, "sig", "left_anti")
    sides = [x.select(F.col("least").alias("file_index"), "sig") for x in (a, rest)]
    rows = [cut(buckets(x, config)) for x in sides]
    # with every bucket the number of blocks of either side
    n = [r.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(c)) for r, c in zip(rows, ("blocks_a", "blocks_b"), strict=True)]
    both = cut(n[0].join(n[1], "bucket"))

    def dealt(r: DataFrame, side: DataFrame, own: str, other: str, is_right: bool) -> DataFrame:
        mine, theirs = ("two", "one") if is_right else ("one", "two")
        met = r.join(both, "bucket").withColumn(mine, F.pmod(F.xxhash64("node"), F.col(own))).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return met.join(side.withColumnRenamed("file_index", "node"), "node").select("bucket", "one", "two", F.lit(is_right).alias("right"), F.col("node").cast("long").alias("node"), "sig")

    all_ = dealt(rows[0], sides[0], "blocks_a", "blocks_b", False).unionByName(dealt(rows[1], sides[1], "blocks_b", "blocks_a", True))
    all_ = all_.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    found = all_.mapInArrow(_nearest, "j long, equal long, i long")
    best = found.groupBy("j").agg(F.max(F.struct("equal", (-F.col("i")).alias("least"))).alias("m")).select("j", F.col("m.equal").alias("equal"), (-F.col("m.least")).alias("i"))
    other = best.join(b.withColumnRenamed("least", "j"), "j").select("sig", "equal", "i")
    settled = cut(same.unionByName(other))
    return right.join(settled, "sig").select(F.col("file_index").alias("j"), (F.col("equal") / F.lit(float(config.slots))).alias("jaccard"), "i")
