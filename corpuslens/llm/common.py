"""Helpers shared by the training-data operators.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; ``bytes.split()`` splits at exactly
those, so texts are handled as UTF-8 bytes and never as decoded strings where words are concerned.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where the session has
    none, a temporary folder is made once and set, on a local master alone: executors elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder among the shared ones, deleted when the session ends."""
    path = f"{scratch_dir(spark).rstrip('/')}/corpuslens-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet into the shared folder and returns the table read back: lineage is cut,
    nothing is computed twice, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpuslens_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by :func:`written` that no later result reads."""
    path = getattr(df, "_corpuslens_path", None)
    if path in _SCRATCH:
        _SCRATCH.remove(path)
        _remove(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _SCRATCH:
            _remove(spark, path)
        _SCRATCH.clear()


def n_words(text: Column) -> Column:
    """Words of a text, natively; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def binaries(column: pa.Array) -> Iterator[bytes]:
    """The values of an Arrow string column as UTF-8 bytes, null as empty; a few at a time."""
    for i in range(0, len(column), 64):
        for x in column.slice(i, 64).cast(pa.large_binary()).to_pylist():
            yield b"" if x is None else x


class WordHashes(dict):
    """64-bit hashes of words; kept for words met before, up to a fixed number."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers for rolling hashes modulo 2^64 (fixed values).
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2^64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        m = MULTIPLIERS[which]
        inverse = np.uint64(pow(int(m), -1, 1 << 64))
        size = max(4096, 1 << n.bit_length())
        up, down = np.full(size, m), np.full(size, inverse)
        up[0] = down[0] = 1
        have = _POWERS[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def windows(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every run of ``size`` consecutive values, from prefix sums; empty if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(which, len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[size:] - sums[:n]) * down[:n])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, by doubling."""
    if len(a) <= width:
        return a.min(keepdims=True) if len(a) else a
    done = 1
    while done * 2 <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    rest = width - done
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of ``size`` that begins at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, n), -1)
    return np.cumsum(steps[:n]) > 0
