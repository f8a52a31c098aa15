"""MinHash signatures and hashed shingle sets straight from texts, as Arrow kernels.

Signatures are those of :func:`corpuslens.functions.text.signature` over :func:`corpuslens.functions.text.shingles`, and no
shingle set leaves a task; hashed sets have a number for each member of the latter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..scratch import cut

PRIME = (1 << 31) - 1
#: Shingles whose slots are worked out at once.
AT_ONCE = 2048
#: Word hashes that a task keeps; sets of fewer members are told apart by the members themselves.
KEPT, FEW = 100_000, 8
_SPACE, _OTHER = re.compile(r"\s+"), re.compile(r"[^a-z0-9 \-]")
#: White space beyond ASCII; of the bytes below it, what white space becomes and what is left out.
_FAR_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BLANKS = bytes(i for i in range(128) if chr(i).isspace())
_TABLE = bytes.maketrans(_BLANKS, b" " * len(_BLANKS))
_DROPPED = bytes(sorted(set(range(128)) - set(_BLANKS) - set(b"abcdefghijklmnopqrstuvwxyz0123456789-")))


def _words(text: str) -> tuple[str, list[str]]:
    """The words of a text and, if there is none, what is left of it."""
    low = text.lower()
    if not low.isascii() and _FAR_SPACE.search(low):
        low = _SPACE.sub(" ", low)
    words = low.encode("ascii", "ignore").translate(_TABLE, _DROPPED).decode("ascii").split()
    return "" if words else _OTHER.sub("", _SPACE.sub(" ", low).strip(" ")), words


def shingle_set(text: str, size: int = 3) -> set[str]:
    """The set of word shingles of a text, by the rule of :func:`corpuslens.functions.text.shingles`."""
    return _shingles(*_words(text), size)


def _shingles(left: str, words: list[str], size: int) -> set[str]:
    if len(words) >= size:
        return set(map(" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    if words:
        return set(words)
    if len(left) >= size:
        return {left[i : i + size] for i in range(len(left) - size + 1)}
    return {left} if left else set()


def _parameters(slots: int) -> tuple[np.ndarray, np.ndarray]:
    number = lambda name: int(hashlib.md5(name.encode()).hexdigest()[:7], 16)  # noqa: E731, S324
    return np.array([number(f"a{k}") + 1 for k in range(slots)], np.int64)[:, None], np.array([number(f"b{k}") for k in range(slots)], np.int64)[:, None]


def _slots(found: set[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each slot's function; the modulus is folded in by shifts, since it is a power of two less one."""
    md5 = hashlib.md5
    h = np.frombuffer(b"".join([md5(s.encode()).digest()[:4] for s in found]), ">u4").astype(np.int64) >> 4
    out = np.full(len(a), PRIME, np.int64)
    for i in range(0, len(h), AT_ONCE):
        x = a * h[None, i : i + AT_ONCE] + b
        x = (x & PRIME) + (x >> 31)
        x = (x & PRIME) + (x >> 31)
        x[x == PRIME] = 0
        np.minimum(out, x.min(axis=1), out=out)
    return out


def signatures(files: DataFrame, config: Config = DEFAULT, raw: bool = False) -> DataFrame:
    """``file_index, sig`` of the files that are long enough and have a shingle. ``raw``: ``sig`` as bytes, four a slot, little-
    endian, the form that bands are cut from; else as an array of longs. Memory: a batch of texts, one text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _parameters(config.slots)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                keep, sigs = [], []
                for k, text in enumerate(some.column("content").to_pylist()):
                    if text is not None and len(text) >= config.min_chars and (found := shingle_set(text, config.shingle)):
                        keep.append(k)
                        sigs.append(_slots(found, a, b))
                ids = some.column("file_index").take(pa.array(keep, pa.int64()))
                if raw:
                    values = pa.array([s.astype("<u4").tobytes() for s in sigs], pa.binary())
                else:
                    flat = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, config.slots), pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, values], ["file_index", "sig"])

    kind = dict(files.dtypes)["file_index"]
    return files.select("file_index", "content").mapInArrow(run, f"file_index {kind}, sig {'binary' if raw else 'array<long>'}")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(texts: list[tuple[str, list[str]]], size: int, known: _Hashes) -> list[np.ndarray]:
    """A 64-bit number for each member of each text's shingle set, ascending."""
    n = np.array([len(words) for _, words in texts], np.int64)
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(words for _, words in texts)), np.uint64, int(n.sum()))
    x = h[: max(0, len(h) - size + 1)]
    for k in range(1, size):
        x = _spread(x) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(x)]
    x, out = _spread(x), []
    for start, m, (left, words) in zip((np.cumsum(n) - n).tolist(), n.tolist(), texts, strict=True):
        if m < size:
            out.append(np.unique(np.array([xxhash.xxh3_64_intdigest(s) for s in _shingles(left, words, size)], np.uint64)))
            continue
        own = np.sort(x[start : start + m - size + 1])
        out.append(own[np.r_[True, own[1:] != own[:-1]]])
    return out


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _hashing(config: Config) -> Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                if len(known) > KEPT:
                    known.clear()
                own = [(k, _words(text)) for k, text in enumerate(some.column("content").to_pylist()) if text is not None and len(text) >= config.min_chars]
                sets = _numbers([x for _, x in own], config.shingle, known)
                keys = [xxhash.xxh3_128_digest("\n".join(sorted(_shingles(*x, config.shingle))) if len(s) < FEW else s.tobytes()) for (_, x), s in zip(own, sets, strict=True)]
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("file_index").take(pa.array([k for k, _ in own], pa.int64())), lists, pa.array(keys, pa.binary())], ["file_index", "sh", "key"])

    return run


def hashed_sets(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``file_index, sh, key`` of the files that are long enough: a 64-bit number for each of the shingles, ascending, and 128 bits
    that equal sets share. Memory: a batch of texts, one text's numbers and the hashes of ``KEPT`` words."""
    texts = files.select("file_index", "content")
    sets = texts.mapInArrow(_hashing(config), f"file_index {dict(files.dtypes)['file_index']}, sh array<long>, key binary")
    sets.hashed_from = texts, config
    return sets


def over_sets(sets: DataFrame, kernel: Kernel, schema: str, bits: np.ndarray | None = None) -> DataFrame:
    """A kernel over sets (``file_index, sh`` and what else they have), of the files that ``bits`` are of (:func:`marks`), if given. Sets that
    come from :func:`hashed_sets` are made in the kernel's own task, of wanted texts alone, so that none goes through the JVM."""
    texts, config = getattr(sets, "hashed_from", (None, None))
    wanted = None if bits is None else sets.sparkSession.sparkContext.broadcast(bits)
    hashing = None if texts is None else _hashing(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:
            batches = (batch.take(pa.array(marked(batch.column("file_index"), wanted.value))) for batch in batches)
        yield from kernel(batches if hashing is None else hashing(batches))

    return (sets if texts is None else texts).mapInArrow(run, schema)


#: Counters of members by which rare ones are told from common ones; every task holds them (8 MB).
BUCKETS = 1 << 20


def _buckets(values: np.ndarray) -> np.ndarray:
    return _spread(values.view(np.uint64)).view(np.int64) & (BUCKETS - 1)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The members of a column of lists, and where each list begins and ends among them."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


#: Counters that travel as one row.
CHUNK = 1 << 14


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, all first bytes first, so that a shuffle's compression takes the high zeros off."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unplanes(body: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many members of all sets fall into each of ``BUCKETS`` buckets; a task sends its counters in ``BUCKETS / CHUNK`` rows,
    and the driver gets as many, 8 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                n += np.bincount(_buckets(_flat(batch.column("sh").slice(i, 256))[0]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(_counters(n), ["chunk", "n"])

    return _added(over_sets(sets, run, "chunk long, n binary"))


def keyed_counts(sets: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``file_index, key`` of the sets (``file_index, sh, key``) that have a member, written, and their :func:`bucket_counts`: one pass
    over the texts for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, names = np.zeros(BUCKETS, np.int64), ["file_index", "key", "chunk", "n"]
        kind = None
        for batch in batches:
            kind = batch.schema.field("file_index").type
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                values, ends = _flat(some.column("sh"))
                n += np.bincount(_buckets(values), minlength=BUCKETS)
                keep = pa.array(np.flatnonzero(np.diff(ends)))
                yield pa.RecordBatch.from_arrays([some.column("file_index").take(keep), some.column("key").take(keep), pa.nulls(len(keep), pa.int64()), pa.nulls(len(keep), pa.binary())], names)
        if kind is not None:
            chunk, body = _counters(n)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(chunk), kind), pa.nulls(len(chunk), pa.binary()), chunk, body], names)

    rows = cut(over_sets(sets, run, f"file_index {dict(sets.dtypes)['file_index']}, key binary, chunk long, n binary"))
    return rows.where("chunk is null").select("file_index", "key"), _added(rows.where("chunk is not null").select("chunk", "n"))


def _counters(n: np.ndarray) -> list[pa.Array]:
    """``chunk, n``; packed small, since a checkpoint is not compressed."""
    own = [(i, n[i * CHUNK : (i + 1) * CHUNK]) for i in range(BUCKETS // CHUNK)]
    own = [(i, zlib.compress(planes(x), 1)) for i, x in own if x.any()]
    return [pa.array([i for i, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())]


def _added(parts: DataFrame) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + unplanes(zlib.decompress(body), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "n"])

    parts = parts.repartition("chunk").mapInArrow(add, "chunk long, n binary")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.toLocalIterator():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.n, "<i8")
    return out


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many prefix members a pair must share whose smaller such number this is; prefixes are longer by as many less one."""
    return 1 + np.minimum(n // 40, 15)


def _rarest(values: np.ndarray, ends: np.ndarray, times: np.ndarray, threshold: float, several: bool = False) -> tuple[np.ndarray, ...]:
    """Of the prefix members of sets that lie one after another: the set, the member and its place, from 1. ``several``: so many that
    similar sets share :func:`least_shared` of them. (Of o common members the k-th has o - k after it in either set, so it is
    among the first n - o + k, and o is n times the threshold at least.)"""
    n = np.diff(ends)
    owner = np.repeat(np.arange(len(n)), n)
    spread = _spread(values.view(np.uint64))
    rank = np.minimum(times[(spread & np.uint64(BUCKETS - 1)).view(np.int64)], (1 << 24) - 1).astype(np.uint64)
    # 8 bits of the set, 24 of the count, 32 of the member; members are ascending, so a stable sort settles what is left
    order = np.argsort(owner.astype(np.uint64) << np.uint64(56) | rank << np.uint64(32) | spread >> np.uint64(32), kind="stable")
    place = np.arange(len(values)) - ends[:-1][owner] + 1
    keep = np.flatnonzero(place <= (n - np.ceil(n * threshold - 1e-9).astype(np.int64) + (least_shared(n) if several else 1))[owner])
    return owner[keep], values[order[keep]], place[keep]


def prefixes(sets: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """``file_index, n, s, r``: each set's rarest members by their buckets' counts, so many that two sets of the threshold's
    similarity must share one; the set's size and the member's place, from 1. Any order of all members would do: counts
    make the common ones last, which keeps candidates few. No row is shuffled."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256)):
            values, ends = _flat(some.column("sh"))
            who, member, place = _rarest(values, ends, shared.value, threshold)
            yield pa.RecordBatch.from_arrays([some.column("file_index").take(pa.array(who)), pa.array(np.diff(ends)[who], pa.int64()), pa.array(member, pa.int64()), pa.array(place, pa.int64())], ["file_index", "n", "s", "r"])

    return over_sets(sets, run, f"file_index {dict(sets.dtypes)['file_index']}, n long, s long, r long")


#: Bits by which files are told apart where only some are wanted; every task holds them (2 MB).
MARKS = 1 << 24


def marks(files: DataFrame) -> np.ndarray:
    """The bits of the files given (``file_index``)."""
    bit = F.pmod(F.col("file_index").cast("long"), F.lit(MARKS))
    rows = files.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(file_index, 64) as int))").alias("bit"))
    out = np.zeros(MARKS // 64, np.int64)
    for r in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r.word] = r.bits
    return out


def marked(ids: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which rows may be of a file that the bits are of."""
    at = ids.cast(pa.int64()).to_numpy() % MARKS
    return np.flatnonzero(bits[at >> 6] >> (at & 63) & 1)


def only(sets: DataFrame, files: DataFrame) -> DataFrame:
    """The sets of the files given, before any shuffle, and of some other files with them: those that have the same of ``MARKS`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield batch.slice(i, 256).select(["file_index", "sh"])
        pa.default_memory_pool().release_unused()

    kinds = dict(sets.dtypes)
    return over_sets(sets, run, f"file_index {kinds['file_index']}, sh {kinds['sh']}", marks(files))


#: Prefix members that a task gathers before it sends them, in 2^10 bins.
GATHERED = 1 << 18


def packed_prefixes(sets: DataFrame, counts: np.ndarray, threshold: float, side: int, bits: np.ndarray | None) -> DataFrame:
    """``bin, side, id, n, s, r``: :func:`prefixes`, of which similar sets share several, with the members of a bin in one row, as
    bytes (some ten a member); of the files that ``bits`` are of, if given. ``s`` is 32 bits of the member, so that with the bin 42 bits are compared."""
    shared = sets.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))
    names = ["bin", "side", "id", "n", "s", "r"]

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, n, member, place = (np.concatenate(x) for x in zip(*held, strict=True))
        h = _spread(member.view(np.uint64))
        bin_ = (h >> np.uint64(54)).astype(np.uint16)
        order = np.argsort(bin_, kind="stable")
        ids, n, s, place = ids[order], n[order].astype("<u4"), h[order].astype("<u4"), place[order].astype("<u4")
        at = np.flatnonzero(np.diff(bin_[order], prepend=-1))
        parts = [[planes(x[a:b]) for a, b in zip(at, [*at[1:], len(order)], strict=True)] for x in (ids, n, s, place)]
        return pa.RecordBatch.from_arrays([pa.array(bin_[order][at], pa.int64()), pa.array(np.full(len(at), side), pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                values, ends = _flat(some.column("sh"))
                who, member, place = _rarest(values, ends, shared.value, threshold, several=True)
                if len(who):
                    held.append((some.column("file_index").cast(pa.int64()).to_numpy()[who], np.diff(ends)[who], member, place))
                    size += len(who)
                if size >= GATHERED:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)
        pa.default_memory_pool().release_unused()

    return over_sets(sets, run, "bin long, side int, id binary, n binary, s binary, r binary", bits)
