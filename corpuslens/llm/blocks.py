"""Comparing all members of a list without writing pairs: lists are cut into blocks, and every two blocks meet in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Pairs of places counted at once.
AT_ONCE = 4_000_000
#: Long lists multiplied at once, and how many products of a matrix cost what one counted pair does.
COLUMNS, PRODUCTS = 1_024, 32


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """The rows of each (key, one, two), which come sorted."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("key", "one", "two")], axis=1)
        cuts = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[a].tolist())
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and their rows, sorted by value; negative values are left out."""
    row, value = np.repeat(np.arange(len(x)), x.shape[1]), x.ravel()
    return sorted_lists(value[value >= 0], row[value >= 0])


def sorted_lists(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(value, kind="stable")
    return value[order], row[order]


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers each row of ``a`` shares with each row of ``b`` (both without repeats in a row)."""
    return counted(*lists(a), len(a), *lists(b), len(b))


def counted(va: np.ndarray, ra: np.ndarray, na: int, vb: np.ndarray, rb: np.ndarray, nb: int) -> np.ndarray:
    """The same from inverted lists of the numbers: every pair of places in a list adds one. Numbers that most rows hold are
    counted as a product of 0/1 matrices instead, a column a number, which whole numbers below 2^24 leave exact."""
    low, many = np.searchsorted(vb, va), np.searchsorted(vb, va, side="right")
    many -= low
    opens = np.flatnonzero(np.append(True, va[1:] != va[:-1])) if len(va) else np.empty(0, np.int64)
    lengths = np.diff(np.append(opens, len(va)))
    long = lengths * many[opens] * PRODUCTS > na * nb
    rest = ~np.repeat(long, lengths)
    out = _listed(ra[rest], na, low[rest], many[rest], rb, nb)
    opens, lengths = opens[long], lengths[long]
    for i in range(0, len(opens), COLUMNS):
        one, two = (np.zeros((n, len(opens[i : i + COLUMNS])), np.float32) for n in (na, nb))
        for k, (at, n) in enumerate(zip(opens[i : i + COLUMNS].tolist(), lengths[i : i + COLUMNS].tolist(), strict=True)):
            one[ra[at : at + n], k] = 1
            two[rb[low[at] : low[at] + many[at]], k] = 1
        out += (one @ two.T).astype(np.int32)
    return out


def _listed(ra: np.ndarray, na: int, low: np.ndarray, many: np.ndarray, rb: np.ndarray, nb: int) -> np.ndarray:
    """Pairs of places: row ``ra[i]`` meets the ``many[i]`` rows that stand from ``low[i]`` in ``rb``."""
    out = np.zeros(na * nb, np.int32)
    ends = np.cumsum(many)
    at = 0
    while at < len(ra):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + AT_ONCE, side="right")))
        n = many[at:to]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
        out += np.bincount(np.repeat(ra[at:to], n) * nb + rb[place], minlength=na * nb).astype(np.int32)
        at = to
    return out.reshape(na, nb)


def join_groups(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Joins the groups of p and q, pair by pair, in ``root``: the least member of each member's group."""
    while True:
        u, v = root[p], root[q]
        if (u == v).all():
            return
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def dealt(postings: DataFrame, blocks: Column) -> DataFrame:
    """Rows with ``key`` and ``id``, in blocks of their lists: each row once for every two blocks that its own is one of.
    blocks: an aggregate over the rows of a list that says into how many blocks it is cut."""
    sizes = written(postings.groupBy("key").agg(F.count("*").alias("n"), blocks.cast("long").alias("blocks")).where("n > 1").drop("n"), "sizes")
    rows = postings.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("one"), F.greatest(x, "block").alias("two")))
    one = F.array(F.struct(F.col("block").alias("one"), F.col("block").alias("two")))
    rows = rows.select(*postings.columns, "block", F.explode(F.when(F.col("blocks") == 1, one).otherwise(meet)).alias("m")).select(*postings.columns, "block", "m.one", "m.two")
    return rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
