"""Packing into sequences of a fixed length with a bounded number of open windows per partition.

Every document becomes pieces of at most ``length`` tokens. A partition keeps ``windows`` open sequences, puts each piece
into the one it fills best, and gives out the fullest when none has room. What is open at the end of a partition is
packed the same way in one merge over groups of partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MODEL, encoder
from .common import written

LENGTH, WINDOWS = 1024, 64
#: Partitions whose leftovers are merged together.
MERGE = 8
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
TYPES = [pa.int64()] * 7


class OpenWindows:
    """At most ``most`` open sequences. ``put`` returns the number of the window, where the piece begins in it, and the
    number of a window that had to close for it, or -1."""

    def __init__(self, length: int, most: int, first: int = 0) -> None:
        self.length, self.most, self.next = length, most, first
        self.open: list[tuple[int, int]] = []  # (room, number), sorted

    def put(self, size: int) -> tuple[int, int, int]:
        closed = -1
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                closed = self.open.pop(0)[1]
            room, number = self.length, self.next
            self.next += 1
        if room > size:
            insort(self.open, (room - size, number))
        return number, self.length - room, closed


def _pieces(model: str, length: int, windows: int, text: str, key: str):
    """First pass: tokenizes and packs; ``open`` marks rows of windows that the partition's end left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        own = OpenWindows(length, windows, TaskContext.get().partitionId() << 32)
        held: dict[int, list[tuple]] = {}

        def out(rows: list[tuple], left: bool) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            arrays = [pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([left] * len(rows), pa.bool_())], [*NAMES, "open"])

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, value in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                ids = enc.ids(value or "") + b"\0\0\0\0"
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    size = len(piece) // 4
                    number, offset, closed = own.put(size)
                    if closed >= 0:
                        rows += held.pop(closed)
                    row = (doc_id, start, size, zlib.crc32(piece), n, number, offset)
                    if offset + size == length:
                        rows += held.pop(number, [])
                        rows.append(row)
                    else:
                        held.setdefault(number, []).append(row)
            yield out(rows, False)
        yield out([r for rows in held.values() for r in rows], True)

    return run


def _merge(length: int, windows: int):
    """Packs leftover pieces again; sequences get numbers of their own, above all of the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OpenWindows(length, windows, (1 << 62) + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            sizes = batch.column("length").to_pylist()
            where = [own.put(s)[:2] for s in sizes]
            columns = {c: batch.column(c) for c in NAMES}
            columns["sequence_id"] = pa.array([x[0] for x in where], pa.int64())
            columns["offset"] = pa.array([x[1] for x in where], pa.int64())
            yield pa.RecordBatch.from_arrays([columns[c] for c in NAMES], NAMES)

    return run


def pack(docs: DataFrame, length: int = LENGTH, windows: int = WINDOWS, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of each document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are those of its whole text and an end id 0. A null or empty text has the end id alone. Repeated rows
    are packed as often as they occur; a null key stays null; an empty table gives no rows. Memory: ``windows`` open
    sequences and one batch. The number of leftovers is at most ``windows`` sequences a partition; they are sorted by size
    (largest first) within groups of partitions and merged with the same rule.
    """
    first = docs.select(key, text).mapInArrow(_pieces(model, length, windows, text, key), f"{FIELDS}, open boolean")
    first = written(first, "pieces")
    left = first.where("open").drop("open")
    group = F.floor(F.shiftright("sequence_id", 32) / MERGE)
    merged = left.withColumn("_g", group).repartition("_g").sortWithinPartitions("_g", F.desc("length"), "doc_id", "start").drop("_g")
    merged = merged.mapInArrow(_merge(length, windows), FIELDS)
    return first.where("not open").drop("open").unionByName(merged)
