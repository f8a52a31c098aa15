"""Corpora of token ids as flat binary files that are memory-mapped.

A corpus is a folder of shards in ascending order of keys. A shard has three files without headers, little-endian:

* ``ids-*.bin``: the ids of its documents one after another, unsigned, 16 bits each if the vocabulary allows it, else 32;
* ``offsets-*.bin``: 64-bit unsigned; for each document the number of ids of all documents of the corpus before it, and
  at the end that after the last one;
* ``keys-*.bin``: 64-bit signed, the documents' keys; null keys stand first, as zero, and the manifest counts them.

The manifest is a Parquet table with a row a shard. Tasks write files under names of their own, and only those that the
manifest names belong to the corpus; so a lost or repeated task leaves no trace in it. A shard's base comes from the prefix
sums of the shards' sizes, which only the manifest's rows take part in. The folder's scheme must be one that pyarrow
opens (a mounted path, ``s3``, ``gs``, ``hdfs``); mounted files are mapped, others are read shard by shard.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_folder, written
from .wordbpe import MODEL, encoder

END = 1
SHARD = "shard int, name string, width int, n_docs long, n_null long, n_ids long"
#: Documents encoded, and read, at once.
AT_ONCE = 64


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))


def _read(place: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(place, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if place.get_file_info(path).size else np.empty(0, kind)
    with place.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _encode(folder: str, model: str, end: int):
    """Writes the ids, keys and sizes of a partition; a row about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name = encoder(model), ""
        width = 2 if enc.size <= 1 << 16 and end < 1 << 16 else 4
        n_docs = n_null = n_ids = 0
        last = np.array([end], f"<u{width}").tobytes()
        with ExitStack() as stack:
            for batch in batches:
                for i in range(0, batch.num_rows, AT_ONCE):
                    if not name:
                        place, top = _place(folder)
                        place.create_dir(top, recursive=True)
                        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                        ids, keys, sizes = (stack.enter_context(place.open_output_stream(f"{top}/{x}-{name}.bin")) for x in ("ids", "keys", "sizes"))
                    key, text = (batch.column(c).slice(i, AT_ONCE) for c in (0, 1))
                    found = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() + last for x in (enc.ids(t or "") for t in text.to_pylist())]
                    ids.write(b"".join(found))
                    keys.write(key.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    size = np.array([len(x) // width for x in found], "<u8")
                    sizes.write(size.tobytes())
                    n_docs, n_null, n_ids = n_docs + len(found), n_null + key.null_count, n_ids + int(size.sum())
        if name:
            row = {"shard": [TaskContext.get().partitionId()], "name": [name], "width": [width], "n_docs": [n_docs], "n_null": [n_null], "n_ids": [n_ids]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("name", pa.string()), ("width", pa.int32()), *((x, pa.int64()) for x in ("n_docs", "n_null", "n_ids"))]))

    return run


def _offsets(folder: str):
    """Writes the offsets of shards whose base is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = _place(folder)
        for batch in batches:
            names = []
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                names.append(f"{name}-{uuid.uuid4().hex}")
                sizes = _read(place, f"{top}/sizes-{name}.bin", "<u8")
                with place.open_output_stream(f"{top}/offsets-{names[-1]}.bin") as out:
                    out.write(np.cumsum(np.concatenate([np.array([base], "<u8"), sizes]), dtype="<u8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], [*batch.schema.names, "offsets"])

    return run


def write(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", model: str = MODEL, end: int = END) -> DataFrame:
    """Writes a corpus and returns its manifest: ``shard, name, width, n_docs, n_null, n_ids, base, offsets, folder``.

    key: an integer column. Documents stand in ascending order of it, nulls first; equal keys in the order of a digest of the
    text, and each repeated row is a document of its own. They are dealt to shards by ranges of both and of the row's place,
    so no key is too frequent for a shard. A null or empty text has the end id alone; other columns don't matter; an empty
    table gives an empty manifest. Memory of a task: a batch, and the ids of its longest text.
    """
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark, "tokens")
    own = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    order = [F.asc_nulls_first("k"), F.asc("h"), F.asc("p")]
    rows = own.withColumns({"h": F.xxhash64("t"), "p": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    shards = written(rows.select("k", "t").mapInArrow(_encode(folder, model, end), SHARD), "shards")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    bases = shards.withColumn("base", F.coalesce(before, F.lit(0)).cast("long")).repartition(max(1, shards.count()))
    done = written(bases.mapInArrow(_offsets(folder), f"{SHARD}, base long, offsets string"), "manifest")
    return done.withColumn("folder", F.lit(folder))


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def read(manifest: DataFrame, value: Callable[[np.ndarray], object] | None = None, kind: pa.DataType | None = None, ddl: str = "ids array<long>") -> DataFrame:
    """A row for each document of a corpus: ``key, start`` (ids of all documents before it)``, n_tokens`` and its ids, or
    what ``value`` makes of them (``kind`` and ``ddl``: its Arrow type, its name and Spark type). Each shard is mapped by one task."""
    kind = kind or pa.list_(pa.int64())
    of = value or (lambda x: x.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                place, top = _place(s["folder"])
                ids, offsets, keys = _read(place, f"{top}/ids-{s['name']}.bin", f"<u{s['width']}"), _read(place, f"{top}/offsets-{s['offsets']}.bin", "<u8"), _read(place, f"{top}/keys-{s['name']}.bin", "<i8")
                for i in range(0, s["n_docs"], AT_ONCE):
                    edge = offsets[i : min(i + AT_ONCE, s["n_docs"]) + 1].astype(np.int64)
                    near = edge - s["base"]
                    place_of = np.arange(i, i + len(edge) - 1)
                    columns = [pa.array(keys[i : i + len(edge) - 1], pa.int64(), mask=place_of < s["n_null"]), pa.array(edge[:-1]), pa.array(np.diff(edge))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([of(ids[a:b]) for a, b in zip(near, near[1:], strict=False)], kind)], ["key", "start", "n_tokens", ddl.split()[0]])

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, f"key long, start long, n_tokens long, {ddl}")
