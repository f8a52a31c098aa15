"""Vectors as short codes: product quantization in whole numbers.

Components become integers ``floor(scale * x)``, and vectors are cut into parts of equal width. The vectors lie in columnar
blocks (a NumPy array with a row a component), written once as a table. A round of the codebooks' training is one
``treeAggregate`` over the RDD of those blocks: distances to a codebook's entries accumulate component by component,
``np.add.at`` adds each part to 64-bit sums and counts of its entry, and these small tensors merge through a reduction
tree. Whole numbers add up alike in any order, so lost and repeated tasks and any partitioning give the same codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bytes of a block, about.
BLOCK = 1 << 19
#: Up to this size, squares, their sums over 2^12 components and sums over 2^37 vectors stay below 2^63; blocks that hold
#: larger numbers are worked out in Python's unbounded integers.
SAFE = 1 << 24
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """``entries``: one array of whole numbers (entry, component) for all parts side by side, ``width`` components a part."""

    entries: np.ndarray
    parts: int
    dimensions: int
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[1] // self.parts

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and place, joined by commas."""
        by_part = self.entries.reshape(len(self.entries), self.parts, self.width).transpose(1, 0, 2)
        return hashlib.sha256(",".join(map(str, by_part.ravel().tolist())).encode()).hexdigest()


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``, exactly: as 16-bit, 32-bit or unbounded integers, whichever holds all. The scale is a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    most = float(np.abs(y).max(initial=0))
    if most < SAFE:
        return y.astype(np.int16 if most < 1 << 15 else np.int32)
    return np.array([math.floor(Fraction(v) * scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def _components(column: pa.Array, dimensions: int, parts: int, scale: int) -> np.ndarray:
    """Component by component; zeros fill the last part up to its width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = whole(flat.reshape(len(column), dimensions), scale).T
    return np.concatenate([out, np.zeros((-dimensions % parts, len(column)), out.dtype)])


def _packed(x: np.ndarray) -> tuple[bytes, str]:
    if x.dtype == object:
        return ",".join(map(str, x.ravel().tolist())).encode(), "text"
    return np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes(), x.dtype.newbyteorder("<").str


def _unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    if kind == "text":
        x = np.empty(data.count(b",") + 1, object)
        x[:] = [int(v) for v in data.split(b",")]
        return x.reshape(-1, n)
    return np.frombuffer(data, kind).reshape(-1, n)


def nearest(block: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector of a block the nearest entry (the lowest among equals) and its squared distance."""
    n, width, entries = block.shape[1], books.width, books.entries
    exact = object if object in (block.dtype, entries.dtype) else np.int64
    best, least = np.empty((books.parts, n), np.int64), np.empty((books.parts, n), exact)
    for p in range(books.parts):
        far = np.zeros((len(entries), n), exact)
        for d in range(p * width, (p + 1) * width):
            away = block[d].astype(exact)[None, :] - entries[:, d].astype(exact)[:, None]
            far += away * away
        best[p] = np.argmin(far, axis=0)
        least[p] = np.take_along_axis(far, best[p][None, :], axis=0)[0]
    return best, least


Sums = tuple[np.ndarray, np.ndarray]


def _added(acc: Sums | None, block: np.ndarray, books: Codebooks) -> Sums:
    """Sums (entry, component) and counts (entry, part) with a block's vectors added."""
    if acc is None:
        acc = np.zeros(books.entries.shape, np.int64), np.zeros((len(books.entries), books.parts), np.int64)
    sums, counts = acc
    best, _ = nearest(block, books)
    if block.dtype == object and sums.dtype != object:
        sums = sums.astype(object)
    for p in range(books.parts):
        np.add.at(counts[:, p], best[p], 1)
        for d in range(p * books.width, (p + 1) * books.width):
            np.add.at(sums[:, d], best[p], block[d].astype(sums.dtype))
    return sums, counts


def _merged(a: Sums | None, b: Sums | None) -> Sums | None:
    return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])


def train(blocks: RDD, start: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """blocks: an RDD of arrays (component, vector). Each round replaces an entry by the floor of its parts' mean; unused
    entries stay. The driver gets the sums of the tree's last level alone: entries x components x 8 bytes each."""
    books = start
    for _ in range(rounds):
        total = blocks.treeAggregate(None, lambda acc, x, books=books: _added(acc, x, books), _merged)
        if total is None:
            break
        sums, counts = total
        n = np.repeat(counts, books.width, axis=1)
        entries = np.where(n > 0, sums // np.maximum(n, 1), books.entries)
        books = Codebooks(entries, books.parts, books.dimensions, books.scale)
    return books


def usable(vector: Column) -> Column:
    """No null, no null component, none that isn't finite."""
    size = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < size)), F.lit(False))


def _blocks(rows: DataFrame, books: Codebooks, columns: list[str]) -> DataFrame:
    """A row for each block: lists of the columns' values, and the components."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = max(1, BLOCK // max(1, 4 * books.entries.shape[1]))
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                data, kind = _packed(_components(part.column("v"), books.dimensions, books.parts, books.scale))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([part.num_rows]), pa.array([kind]), pa.array([data], pa.binary())], [*columns, "n", "kind", "data"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` array<{kinds[c]}>" for c in columns) + ", n long, kind string, data binary")


@dataclass(frozen=True)
class Compressed:
    """``rows``: ``key, label, code`` (array of entry numbers in the order of parts)``, error``; ``books``: None for an empty table."""

    rows: DataFrame
    books: Codebooks | None


def compress(df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Trains a codebook for each part and codes every vector.

    Left out are vectors that :func:`usable` refuses and those of another length than the one with the smallest key. The
    codebooks start as the vectors with the smallest keys, one an entry; equal keys in the order of their vectors, null keys
    last; fewer vectors make fewer entries. A length that the parts don't divide is filled up with zeros. Repeated rows count
    as often as they occur; other columns don't matter; errors above 2^63 - 1 are given as that. Memory of a task:
    a block, and tensors of entries x components.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v")).where(usable(F.col("v")))
    order = [F.asc_nulls_last("key"), F.asc("v")]
    head = rows.orderBy(*order).limit(1).select(F.size("v").alias("d")).first()
    kinds = dict(rows.dtypes)
    if head is None:
        return Compressed(rows.select("key", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), None)
    rows = rows.where(F.size("v") == head.d)
    first = [r.v for r in rows.orderBy(*order).limit(entries).collect()]
    first = np.array(first, np.float64).reshape(len(first), head.d)
    start = whole(first, scale)
    start = np.concatenate([start, np.zeros((len(start), -head.d % parts), start.dtype)], axis=1)
    books = Codebooks(start if start.dtype == object else start.astype(np.int64), parts, head.d, scale)
    blocks = written(_blocks(rows, books, ["key", "label"]), "blocks")
    books = train(blocks.select("n", "kind", "data").rdd.map(lambda r: _unpacked(bytes(r.data), r.kind, r.n)), books, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, kind, n = (batch.column(c)[i].as_py() for c in ("data", "kind", "n"))
                best, least = nearest(_unpacked(data, kind, n), books)
                error = least.sum(axis=0)
                if error.dtype == object:
                    error = [min(x, LONG) for x in error.tolist()]
                code = pa.ListArray.from_arrays(pa.array(np.arange(0, n * parts + 1, parts), pa.int32()), pa.array(best.T.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("key")[i].values, batch.column("label")[i].values, code, pa.array(error, pa.int64())], ["key", "label", "code", "error"])

    return Compressed(blocks.select("key", "label", "n", "kind", "data").mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, code array<int>, error long"), books)


def digest(done: Compressed) -> DataFrame:
    """``key, code`` (two hex digits a part)``, error, label_error`` (the errors of equal labels together, nulls too)``, codebooks_sha256``."""
    hexed = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    rows = written(done.rows.select("key", "label", hexed.alias("code"), "error"), "codes")
    sums = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("key", "code", "error", "label_error", F.lit(done.books.sha256() if done.books else "").alias("codebooks_sha256"))


def decode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The vectors that codes stand for: ``key, vector``."""
    width = books.width
    tables = F.array(*[F.array(*[F.array(*map(F.lit, (e[p * width : (p + 1) * width] / books.scale).astype(float).tolist())) for e in books.entries]) for p in range(books.parts)])
    vector = F.flatten(F.zip_with(tables, F.col("code"), lambda t, i: t[i]))
    return rows.select("key", F.slice(vector, 1, books.dimensions).alias("vector"))

