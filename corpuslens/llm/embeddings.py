"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by the pivots nearest to it, in order (its permutation's head). Inverted lists hold, for each
pivot, the vectors that have it among their first few; a list carries numbers and permutations, not vectors. In a list the
pivots that two vectors share are counted, over the whole heads, and pairs with enough of them are candidates. Only vectors
with a candidate are then sent, once for each list where they have one, and pairs are verified by their cosine in double
precision. A pair is looked at in one list alone, that of the least pivot among the first few of both.

Pivots are points of the data, after what all vectors have in common is taken off (the mean direction, over all of them): a
sample of at most SAMPLE distinct vectors, those with the smallest hashes, without points close to an earlier one; where they
are fewer than the index wants, random directions from a fixed seed fill it up. Every vector is indexed. Taking the mean off
turns a pair at the bound further apart, by as much as the mean is long, and the index is wider for that. Since the index
follows the number of vectors and their mean, a link at the edge of its recall may come or go as rows are added. Equal
vectors are one entry, so groups of copies meet nobody twice. Long lists are searched in blocks, every two blocks in a task of their own;
pairs are counted where they meet and never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import dealt, groups, join_groups, shared
from .common import drop_written, written
from .components import connected_components

COSINE = 0.9
#: A longer inverted list is cut into blocks.
BLOCK = 2_048
#: Vectors of which pivots are made, the cosine from which one of two of them goes, the lengths of vectors that have a mean, and
#: the least cosine that a pair at the bound may be left with.
SAMPLE, CLOSE, LENGTHS, LEFT = 4_096, 0.7, 16, 0.5
#: A component of a unit vector as a whole number, so that sums don't depend on their order.
SCALE = 1 << 28


def index_shape(n: int, left: float = COSINE) -> tuple[int, int, int, int]:
    """For n distinct vectors: pivots, the pivots that describe a vector, the first of them whose lists it is in, and how many
    two candidates must share. Pivots grow as the root of n, without an end, and with them the other two. ``left``: the cosine
    of a pair at the bound once the mean is taken off; the index widens as it falls."""
    more = max(0, (4 * int(n**0.5)).bit_length() - 10)
    wide = max(1.0, 0.9 / left) ** 2.3
    pivots = max(256, 1 << (4 * int(n**0.5)).bit_length()) << int(np.ceil(np.log2(wide) - 0.25))
    return pivots, int(np.ceil((16 + 2 * more) * wide)), int(np.ceil((6 + more) * wide)), 5


def off_mean(mean: np.ndarray, cosine: float) -> tuple[np.ndarray, float]:
    """What is taken off the unit vectors with that mean, and the cosine of a pair at the bound afterwards. The whole mean goes
    if that cosine stays at LEFT or more, else a part of it: where all vectors are alike, hardly any."""
    c = float(mean @ mean)
    if c < 1e-4:
        return np.zeros_like(mean), cosine
    if c > 1 - 1e-6:
        return np.zeros_like(mean), cosine
    stays = max(0.0, (LEFT * (1 - c) - (cosine - c)) / (1 - LEFT))
    share = 1 - min(1.0, (stays / c) ** 0.5)
    rest = (1 - share) ** 2 * c
    return share * mean, min(cosine, (rest + cosine - c) / (rest + 1 - c))


def taken_off(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit vectors without the mean, at unit length; those of which nothing is left stay as they are."""
    y = x - mean
    size = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return np.where(size > 1e-9, y / np.maximum(size, 1e-9), x)


def apart(points: np.ndarray) -> np.ndarray:
    """The unit points that are not close to an earlier one that stays."""
    near = points @ points.T >= CLOSE
    kept: list[int] = []
    gone = np.zeros(len(points), bool)
    for i in range(len(points)):
        if not gone[i]:
            kept.append(i)
            gone |= near[i]
    return points[kept]


def _means(kind: str):
    """``d, at, s, n``: by length of vectors the sums of their units' components, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        width = np.dtype(kind).itemsize
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            sizes = np.array([len(r) // width for r in raw], np.int64)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d).tolist()
                for i in range(0, len(own), 256):
                    part = np.rint(_unit([raw[j] for j in own[i : i + 256]], kind) * SCALE).astype(np.int64).sum(axis=0)
                    sums[d] = sums.get(d, 0) + part
                counts[d] = counts.get(d, 0) + len(own)
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(s), pa.array(np.full(d, counts[d]))], ["d", "at", "s", "n"])

    return run


def reference_points(nodes: DataFrame, cosine: float, kind: str) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], float]:
    """By length of vectors what is taken off them and the sample's points, for the LENGTHS most frequent ones; and the least
    cosine of a pair at the bound afterwards. nodes: ``node, vector``. The driver gets SAMPLE vectors and a row a component."""
    sums = nodes.select("vector").mapInArrow(_means(kind), "d long, at long, s long, n long").groupBy("d", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("double").alias("s"), F.sum("n").alias("n"))
    most = sums.where("at = 0").orderBy(F.desc("n"), "d").limit(LENGTHS).select("d")
    found: dict[int, dict[int, float]] = {}
    for r in sums.join(most, "d", "left_semi").collect():
        found.setdefault(r.d, {})[r.at] = r.s / SCALE / r.n
    sample = nodes.select("vector", F.xxhash64("node").alias("h"), "node").orderBy("h", "node").limit(SAMPLE).select("vector").collect()
    out, left = {}, cosine
    for d, mean in found.items():
        off, after = off_mean(np.array([mean[i] for i in range(d)]), cosine)
        own = [bytes(r.vector) for r in sample if len(r.vector) == d * np.dtype(kind).itemsize]
        points = apart(taken_off(_unit(own, kind), off)) if own else np.empty((0, d))
        out[d], left = (off, points), min(left, after)
    return out, left


def _vectors(kind: str):
    """``vec_id, node, vector``: a digest and the numbers of each usable vector; else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, raw = [], []
            for v in batch.column("embedding"):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, kind) + 0.0  # one zero
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    nodes.append(None)
                    raw.append(None)
                else:
                    raw.append(x.astype(kind).tobytes())
                    nodes.append(xxhash.xxh3_128_digest(raw[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(nodes, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "node", "vector"])

    return run


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(pivots: int, size: int, seed: int) -> np.ndarray:
    g = np.random.default_rng([seed, size]).normal(size=(pivots, size))
    return g / np.sqrt((g * g).sum(axis=1, keepdims=True))


def permutations(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first."""
    close = x @ pivots.T
    some = np.argpartition(-close, near - 1, axis=1)[:, :near] if near < close.shape[1] else np.argsort(-close, axis=1)
    return np.take_along_axis(some, np.lexsort((some, -np.take_along_axis(close, some, axis=1)), axis=1), axis=1)


def _described(points, pivots: int, near: int, first: int, seed: int, kind: str):  # noqa: ANN001
    """``id, copies, head, lists``: the nearest pivots of each vector as 32-bit numbers, and the lists that it is in. points:
    a broadcast of :func:`reference_points`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        width = np.dtype(kind).itemsize
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            sizes = np.array([len(r) // width for r in raw], np.int64)
            heads: list[bytes] = [b""] * len(raw)
            lists = np.zeros((len(raw), first), np.int64)
            for d in np.unique(sizes).tolist():
                if d not in known:
                    off, own = points.value.get(d, (np.zeros(d), np.empty((0, d))))
                    own = own[:pivots]
                    known[d] = off, np.concatenate([own, directions(pivots - len(own), d, seed)])
                at = np.flatnonzero(sizes == d).tolist()
                for i in range(0, len(at), 256):
                    off, of = known[d]
                    order = permutations(taken_off(_unit([raw[j] for j in at[i : i + 256]], kind), off), of, near).astype("<u4")
                    for j, head in zip(at[i : i + 256], order, strict=True):
                        heads[j] = head.tobytes()
                        lists[j] = d * pivots + head[:first].astype(np.int64)
            column = pa.ListArray.from_arrays(np.arange(0, lists.size + 1, first, dtype=np.int32), lists.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), pa.array(heads, pa.binary()), column], ["id", "copies", "head", "lists"])

    return run


def candidates(key: int, heads_a: np.ndarray, heads_b: np.ndarray, first: int, enough: int) -> np.ndarray:
    """Which pairs share enough pivots and have ``key`` as the least pivot among the first few of both."""
    found = shared(heads_a, heads_b) >= enough
    if found.any():
        found &= shared(np.where(heads_a[:, :first] < key, heads_a[:, :first].astype(np.int64), -1), np.where(heads_b[:, :first] < key, heads_b[:, :first].astype(np.int64), -1)) == 0
    return found


def _sides(key: tuple[int, int, int], rows: pa.Table, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads = np.frombuffer(b"".join(rows.column("head").to_pylist()), "<u4").reshape(-1, near).astype(np.int64)
    block = rows.column("block").to_numpy()
    a = np.flatnonzero(block == key[1])
    return heads, a, a if key[1] == key[2] else np.flatnonzero(block == key[2])


def _counted(pivots: int, near: int, first: int, enough: int):
    """``key, id``: the vectors of a list that have a candidate there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groups(batches):
            if rows.num_rows < 2:
                continue
            heads, a, b = _sides(key, rows, near)
            found = candidates(key[0] % pivots, heads[a], heads[b], first, enough)
            if key[1] == key[2]:
                np.fill_diagonal(found, False)
            has = np.unique(np.concatenate([a[found.any(axis=1)], b[found.any(axis=0)]]))
            if len(has):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), key[0], np.int64)), rows.column("id").combine_chunks().take(pa.array(has))], ["key", "id"])

    return run


def _verified(pivots: int, near: int, first: int, enough: int, cosine: float, kind: str):
    """``id, links, other``: how many vectors link to this one here, and the least one that links reach here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groups(batches):
            if rows.num_rows < 2:
                continue
            heads, a, b = _sides(key, rows, near)
            x = _unit(rows.column("vector").to_pylist(), kind)
            copies, ids = rows.column("copies").to_numpy(), rows.column("id").to_numpy()
            counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for s in range(0, len(a), 512):
                part = a[s : s + 512]
                near_ = (x[part] @ x[b].T >= cosine) & (part[:, None] != b[None, :])
                if not near_.any():
                    continue
                near_ &= candidates(key[0] % pivots, heads[part], heads[b], first, enough)
                i, j = np.nonzero(near_)
                p, q = part[i], b[j]
                np.add.at(counts, p, copies[q])
                if key[1] != key[2]:
                    np.add.at(counts, q, copies[p])
                join_groups(root, p, q)
            linked = np.flatnonzero(counts)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(counts[linked]), pa.array(ids[root[linked]])], ["id", "links", "other"])

    return run


def near_duplicates(df: DataFrame, cosine: float = COSINE, seed: int = 3, shape: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``df`` (``vec_id, embedding``).

    Two vectors link if their cosine is at least ``cosine`` and the index finds them (recall is measured in the tests;
    no pair below the bound links). Null and zero vectors and vectors with null or non-finite components
    link with nothing and are kept. ``n_links`` counts the other rows linked directly, copies included. Vectors of
    different lengths never link. Rows with a null vec_id link and count but name no component.
    """
    kind = "<f4" if dict(df.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = df.select("vec_id", "embedding").mapInArrow(_vectors(kind), "vec_id long, node binary, vector binary")
    rows = written(rows, "vectors")
    # One vector of each group of copies; numbers are given once, when the table is written.
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    points, left = reference_points(nodes, cosine, kind)
    pivots, near, first, enough = shape or index_shape(nodes.count(), left)
    points = df.sparkSession.sparkContext.broadcast(points)
    heads = nodes.select("id", "copies", "vector").mapInArrow(_described(points, pivots, near, first, seed, kind), "id long, copies long, head binary, lists array<long>")
    heads = written(heads, "heads")
    postings = heads.select("id", "head", F.explode("lists").alias("key"))
    wanted = dealt(postings, F.ceil(F.count("*") / BLOCK)).mapInArrow(_counted(pivots, near, first, enough), "key long, id long")
    wanted = written(wanted.distinct(), "wanted")
    sent = wanted.join(heads.select("id", "copies", "head"), "id").join(nodes.select("id", "vector"), "id")
    found = written(dealt(sent, F.ceil(F.count("*") / BLOCK)).mapInArrow(_verified(pivots, near, first, enough, cosine, kind), "id long, links long, other long"), "links")
    drop_written(wanted)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    state = nodes.select("id", "node", "copies").join(links, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    state = state.select(F.col("node").alias("_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("_root"))
    rooted = written(rows.select("vec_id", "node").join(state, F.col("node") == F.col("_node"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "_root"), "rooted")
    least = rooted.where("_root is not null").groupBy(F.col("_root").alias("r")).agg(F.min("vec_id").alias("least"))
    least = written(least, "components")
    out = rooted.join(least, F.col("_root") == F.col("r"), "left").withColumn("component_id", F.when(F.col("_root").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
