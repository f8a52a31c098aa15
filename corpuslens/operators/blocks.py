"""Sums over all pairs of a group's sets without a row a pair: groups are cut into blocks, and every two blocks meet in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import only
from ..scratch import cut

#: Sets of a block, and shared members counted at once.
BLOCK, COLUMNS = 256, 4096


def sorted_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each value of the columns ``by``, which come sorted by them."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                if held and keys[at] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = keys[at]
                held.append(batch.slice(at, i - at))
                at = i
    if held:
        yield now, pa.Table.from_batches(held)


def overlaps(code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many members each two of n sets share; ``code`` and ``row`` list the members of each set once."""
    times = np.bincount(code)
    many = np.flatnonzero(times > 1)  # a member of one set alone is shared by none
    place = np.full(len(times), -1)
    place[many] = np.arange(len(many))
    keep = place[code] >= 0
    column, row = place[code[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((n, n), np.float64)
    for at in range(0, len(many), COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((n, min(COLUMNS, len(many) - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[int, float]] = []
    for (cluster, one, two), table in sorted_groups(batches, ("cluster_id", "one", "two")):
        lists = table.column("sh").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        code = lists.flatten().dictionary_encode().indices.to_numpy()
        shared = overlaps(code, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
        jaccard = shared / (sizes[:, None] + sizes[None, :] - shared)
        w, block = table.column("w").to_numpy().astype(float), table.column("block").to_numpy()
        pairs = np.triu(np.ones_like(jaccard, bool), 1) if one == two else (block[:, None] == one) & (block[None, :] == two)
        found.append((cluster, float((jaccard * w[:, None] * w[None, :])[pairs].sum())))
        if len(found) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], ["cluster_id", "s"])
            found = []
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], ["cluster_id", "s"])


def weighted_sums(weights: DataFrame, sets: DataFrame) -> DataFrame:
    """``cluster_id, s``: the similarities of all pairs of a cluster's different sets, times both weights, added up; a row for
    every two blocks of a cluster at most. weights: ``cluster_id, rep, w``, a written table; sets: ``file_index, sh``."""
    sizes = cut(weights.groupBy("cluster_id").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = weights.join(sizes, "cluster_id").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("one"), F.greatest(x, "block").alias("two")))
    rows = cut(rows.withColumn("m", F.explode(meet)).select("cluster_id", "rep", "w", "block", "m.one", "m.two"))
    # the sets join last, so that they are shuffled to their blocks once
    wanted = only(sets, rows.select(F.col("rep").alias("file_index")).distinct()).withColumnRenamed("file_index", "rep")
    rows = rows.join(wanted, "rep").select("cluster_id", "one", "two", "block", "w", "sh")
    rows = rows.repartition("cluster_id", "one", "two").sortWithinPartitions("cluster_id", "one", "two")
    return rows.mapInArrow(_sums, "cluster_id long, s double")
