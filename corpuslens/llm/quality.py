"""Quality rules: counts of words, symbols and repeats, and an n-gram model's perplexity.

The model is an interpolated modified Kneser-Ney model of order two, counted by Spark over all texts. Its units are pieces of
words: runs of letters and digits, and runs of marks, are cut into pieces of four code points (ideographs, kana, Hangul and
what lies beyond stand alone), so common short words are units of their own. A piece with a share of at least 1 in VOCABULARY
of all pieces has a number, so there are at most VOCABULARY of them at any size; all others are spelled in bytes. The table
of pairs of pieces grows with the corpus. It is kept as sorted hash arrays: rows of shards, each with the sorted, scrambled
pair numbers and their counts.

Texts are scored where they are read by the pairs with a share of at least 1 in HOT (at most HOT pairs, a proven bound for the
broadcast); the other pairs of a text go to the shards of the table, and sums come back. All costs are whole numbers, so neither
the share nor the order of rows changes a result. The bits of a text are divided by its runs of letters, marks left out: junk
that strews marks between words costs more a word. Every language has a lower and an upper band, set from the spread over all
its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binaries, covered, mixed, windows, written

MIN_WORDS, REPEAT, MAX_REPEAT_PERCENT = 20, 8, 30
#: The band: so many times the distance from the median to the quartiles, at least LEAST bits, more for texts of few words.
WIDTH, LEAST, SHORT = 9.0, 0.2, 50.0
#: Code points in a piece; 1 in so many pieces makes a unit; 1 in so many pairs makes a pair that is sent to all.
PIECE, VOCABULARY, HOT = 4, 1 << 18, 1 << 21
#: Numbers of units: 0 starts a text, 1 to 256 are bytes, then the vocabulary; a pair has 2 * UNIT_BITS bits.
UNIT_BITS, FIRST = 19, 257
PAIRS = np.uint64((1 << 2 * UNIT_BITS) - 1)
#: An odd multiplier modulo 2^38 and its inverse spread pair numbers evenly over the shards.
SPREAD = 0x9E3779B97F4A7C15 % (1 << 2 * UNIT_BITS)
GATHER = pow(SPREAD, -1, 1 << 2 * UNIT_BITS)
#: Pieces for which a shard of the table is made, pairs gathered in a worker before they are sent on, and bytes of text
#: looked at together (longer texts are read on from their last space).
SHARD, HELD, BLOCK = 16_000_000, 500_000, 1 << 18
LEAST_SHARDS = 32
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
#: Classes of bytes that begin a code point: 0 white space, 1 letters, digits and all beyond ASCII, 2 marks.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = 1
_CLASS[_SPACES] = 0
_ALONE = np.arange(256) >= 0xE2  # lead bytes of code points that stand alone


@dataclass
class Pieces:
    """Of a block of texts: hashes, bytes, and which text each piece belongs to."""

    raw: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    terms: np.ndarray  # runs of letters by text


def pieces(texts: list[bytes]) -> Pieces:
    joined = b"\n".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at]
    kind = _CLASS[lead]
    run = np.ones(len(at), bool)
    run[1:] = kind[1:] != kind[:-1]
    n = np.arange(len(at))
    inside = n - np.maximum.accumulate(np.where(run, n, 0))
    cut = run | (inside % PIECE == 0) | _ALONE[lead]
    cut[1:] |= _ALONE[lead[:-1]]
    begin = np.flatnonzero(cut)
    starts = at[begin]
    sizes = np.diff(np.append(starts, len(raw)))
    real = kind[begin] != 0
    head = run[begin][real]
    letters = kind[begin][real] == 1
    starts, sizes = starts[real], sizes[real]
    hashes = np.where(head, np.uint64(1), np.uint64(2))
    for k in range(int(sizes.max(initial=0))):
        longer = np.flatnonzero(sizes > k)
        hashes[longer] = hashes[longer] * np.uint64(0x100000001B3) + raw[starts[longer] + k] + np.uint64(1)
    owner = np.searchsorted(ends, starts, side="right")
    return Pieces(raw, starts, sizes, mixed(hashes), owner, np.bincount(owner[head & letters], minlength=len(texts)))


def units(p: Pieces, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of units and the text of each; vocabulary: sorted hashes."""
    if not len(vocabulary):
        vocabulary = np.array([0], np.uint64)
    found = np.minimum(np.searchsorted(vocabulary, p.hashes), len(vocabulary) - 1)
    known = vocabulary[found] == p.hashes
    many = np.where(known, 1, p.sizes)
    which = np.repeat(np.arange(len(many)), many)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    out = np.where(known[which], found[which] + FIRST, p.raw[np.minimum(p.starts[which] + inner, len(p.raw) - 1)] + np.int64(1))
    return out, p.owner[which]


def pairs_of(ids: np.ndarray, owner: np.ndarray, before: int) -> np.ndarray:
    """Scrambled numbers of the pairs that end in each unit; ``before``: the unit before the first text's first."""
    left = np.zeros(len(ids), np.uint64)
    left[1:] = np.where(owner[1:] == owner[:-1], ids[:-1], 0).astype(np.uint64)
    if len(ids) and owner[0] == 0:
        left[0] = before
    return (((left << np.uint64(UNIT_BITS)) | ids.astype(np.uint64)) * np.uint64(SPREAD)) & PAIRS


def parts_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both units of scrambled pairs."""
    plain = (key * np.uint64(GATHER)) & PAIRS
    return (plain >> np.uint64(UNIT_BITS)).astype(np.int64), (plain & np.uint64((1 << UNIT_BITS) - 1)).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes], bool, bool]]:
    """Texts in groups of about BLOCK bytes: batch, rows, parts of their texts, and whether the group goes on with the text that
    the one before ended in, and whether its last text goes on."""
    for batch in batches:
        rows, parts, size = [], [], 0
        for i, text in enumerate(binaries(batch.column("text"))):
            if size and size + len(text) > BLOCK:
                yield batch, rows, parts, False, False
                rows, parts, size = [], [], 0
            at = 0
            while len(text) - at > 2 * BLOCK:
                end = max(text.rfind(b" ", at, at + BLOCK), text.rfind(b"\n", at, at + BLOCK)) + 1
                if end <= at:  # no space: between two code points
                    end = at + BLOCK
                    while text[end] & 0xC0 == 0x80:
                        end -= 1
                yield batch, [i], [text[at:end]], at > 0, True
                at = end
            if at:
                yield batch, [i], [text[at:]], True, False
                continue
            rows.append(i)
            parts.append(text)
            size += len(text)
        if rows:
            yield batch, rows, parts, False, False


def packed(a: np.ndarray) -> bytes:
    """An array of whole numbers, its bytes by place, compressed."""
    a = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(a)).tobytes() + np.ascontiguousarray(a.T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8).reshape(8, -1).T).reshape(-1).view("<u8")


def packed_sorted(a: np.ndarray) -> bytes:
    return packed(np.diff(a, prepend=np.uint64(0)))


def unpacked_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Gathered:
    """Counts of keys, bounded in memory: ``add`` returns what must go out when over HELD different keys are held."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, 2 * HELD

    def add(self, keys: np.ndarray) -> bool:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > self.limit:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
            return self.size > HELD
        return False

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]).astype(np.int64))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.parts, self.size = [], 0
        return out


def _piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Gathered()

    def out() -> pa.RecordBatch:
        keys, n = held.take()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["piece", "n"])

    for _, _, parts, _, _ in blocks(batches):
        if held.add(pieces(parts).hashes):
            yield out()
    yield out()


def _by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """Shard, begin and end of each stretch of sorted keys; shards is a power of two."""
    shift = np.uint64(2 * UNIT_BITS - (shards.bit_length() - 1))
    own = (keys >> shift).astype(np.int64)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    return list(zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(own)], strict=True)) if len(own) else []


def _pair_counts(vocabulary: Broadcast, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = Gathered(), 0

        def out() -> pa.RecordBatch:
            keys, n = held.take()
            found = _by_shard(keys, shards)
            columns = [[s for s, _, _ in found], [packed_sorted(keys[a:b]) for _, a, b in found], [packed(n[a:b]) for _, a, b in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "keys", "counts"])

        for _, _, parts, going, _ in blocks(batches):
            ids, owner = units(pieces(parts), vocabulary.value)
            keys = pairs_of(ids, owner, before if going else 0)
            before = int(ids[-1]) if len(ids) else before if going else 0
            if held.add(keys):
                yield out()
        yield out()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard become one row a shard."""
    now, keys, counts = -1, [], []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate(keys), np.concatenate(counts))

    def out() -> pa.RecordBatch:
        k, n = merged()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed_sorted(k)], pa.binary()), pa.array([packed(n)], pa.binary())], ["shard", "keys", "counts"])

    for batch in batches:
        for shard, k, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if shard != now and keys:
                yield out()
                keys, counts = [], []
            now = shard
            keys.append(unpacked_sorted(k))
            counts.append(unpacked(n).astype(np.int64))
            if len(keys) > 1 and sum(map(len, keys[1:])) > len(keys[0]) + HELD:
                k, n = merged()
                keys, counts = [k], [n]
    if keys:
        yield out()


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By unit: how many pairs begin with it once, twice, more often, and their sum; and how many end in it. Unit -1: how
    many pairs have each count from 1 to 4."""
    size = 1 << UNIT_BITS
    table, of = np.zeros((5, size), np.int64), np.zeros(5, np.int64)
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            (a, b), n = parts_of(unpacked_sorted(keys)), unpacked(counts).astype(np.int64)
            for i in range(3):
                table[i] += np.bincount(a[n == i + 1 if i < 2 else n > 2], minlength=size)
            table[3] += np.bincount(a, n, size).astype(np.int64)
            table[4] += np.bincount(b, minlength=size)
            of += [int((n == i).sum()) for i in (1, 2, 3, 4)] + [0]
    used = np.flatnonzero(table.any(axis=0))
    columns = [np.append(used, -1), *(np.append(x[used], y) for x, y in zip(table, of, strict=True))]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["unit", "c1", "c2", "c3", "total", "kinds"])


def _discounts(counts: np.ndarray) -> np.ndarray:
    return losses([int((counts == i).sum()) for i in (1, 2, 3, 4)])


def losses(of: list[int]) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more lose (Chen and Goodman, 1999), from counts of counts of 1 to 4, each with one more."""
    n1, n2, n3, n4 = (x + 1.0 for x in of)
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d[i], 0.1), i - 0.1) for i in (1, 2, 3))])


@dataclass
class Smoothing:
    """By unit: the count of pairs that begin with it, the mass that their counts lose, and its own lower-order share."""

    loss: np.ndarray
    total: np.ndarray
    freed: np.ndarray
    lower: np.ndarray

    def costs(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Millionths of a bit."""
        a, b = parts_of(keys)
        share = (n - self.loss[np.minimum(n, 3)] + self.freed[a] * self.lower[b]) / self.total[a]
        return np.round(-np.log2(share) * 1_000_000).astype(np.int64)


def _smoothing(table: DataFrame) -> Smoothing:
    """From one row a unit, at most VOCABULARY + 258 of them."""
    counts = table.mapInArrow(_unit_counts, "unit long, c1 long, c2 long, c3 long, total long, kinds long").groupBy("unit")
    rows = counts.agg(*[F.sum(c).alias(c) for c in ("c1", "c2", "c3", "total", "kinds")]).toArrow()
    unit, c1, c2, c3, total, kinds = (rows.column(i).to_numpy().astype(np.int64) for i in range(6))
    of = np.stack([c1, c2, c3, total, kinds], axis=1)[unit < 0].sum(axis=0)
    full = np.zeros((5, 1 << UNIT_BITS), np.int64)
    for x, c in zip(full, (c1, c2, c3, total, kinds), strict=True):
        x[unit[unit >= 0]] = c[unit >= 0]
    loss, k = losses(of[:4].tolist()), full[4]
    low = _discounts(k)
    words, every = max(1, int((k > 0).sum())), max(1.0, float(k.sum()))
    rest = sum(float(low[i]) * int((k == i).sum() if i < 3 else (k > 2).sum()) for i in (1, 2, 3))
    return Smoothing(loss, full[3], loss[1] * full[0] + loss[2] * full[1] + loss[3] * full[2], np.where(k > 0, (k - low[np.minimum(k, 3)]) / every + rest / every / words, 0.0))


class Model:
    """The table of pairs and what all workers get: the vocabulary, the smoothing and the hot pairs, all of bounded size."""

    def __init__(self, docs: DataFrame) -> None:
        spark = docs.sparkSession
        texts = docs.select("text").where("text is not null")
        counts = written(texts.mapInArrow(_piece_counts, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
        self.total = counts.agg(F.sum("n")).first()[0] or 0
        # n * VOCABULARY >= total holds for at most VOCABULARY pieces
        units_ = counts.where(F.col("n") * VOCABULARY >= self.total).select("piece").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
        self.vocabulary = spark.sparkContext.broadcast(np.sort(units_))
        self.shards = max(LEAST_SHARDS, 1 << (self.total // SHARD).bit_length())
        sent = texts.mapInArrow(_pair_counts(self.vocabulary, self.shards), "shard int, keys binary, counts binary")
        self.table = written(sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(_merge, "shard int, keys binary, counts binary"), "pairs")
        self.smoothing = spark.sparkContext.broadcast(_smoothing(self.table))
        self.hot = spark.sparkContext.broadcast(self._hot())

    def costs(self, least: int = 0) -> DataFrame:
        """``pair, cost`` of the pairs with a count of ``least`` or more."""
        smoothing = self.smoothing

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    k, n = unpacked_sorted(keys), unpacked(counts).astype(np.int64)
                    k, n = k[n >= least], n[n >= least]
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(smoothing.value.costs(k, n))], ["pair", "cost"])

        return self.table.mapInArrow(run, "pair long, cost long")

    def _hot(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that make up 1 in HOT or more of all pairs, so at most HOT of them, with their costs."""
        pairs = int(self.smoothing.value.total.sum())
        rows = self.costs(max(1, -(-pairs // HOT))).toArrow()
        keys, cost = (rows.column(i).to_numpy().astype(np.int64) for i in range(2))
        order = np.argsort(keys)
        return keys[order].view(np.uint64), cost[order]


def pair_costs(docs: DataFrame) -> DataFrame:
    """``pair, cost`` (millionths of a bit) of every different pair of units of the texts."""
    return Model(docs).costs()


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of 8 that are found twice or more in the text."""
    w = windows(hashes, REPEAT)
    if len(w) < 2:
        return 0
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return int(covered(np.flatnonzero(again), REPEAT, len(hashes)).sum())


def counts_of(text: bytes, known: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words, b = text.split(), np.frombuffer(text, np.uint8)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = int(((b & 0xC0) != 0x80).sum() - _SPACES[b].sum())
    return len(words), chars, int(_SYMBOLS[b].sum()), len(lines) - len(set(lines)), repeated_words(known.of(words))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("key", pa.int64()), *((x.split()[0], pa.int64()) for x in COUNTS.split(", ")), ("n_terms", pa.int64()), ("cost", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("rows", pa.binary())])


def _score(vocabulary: Broadcast, hot: Broadcast, shards: int):
    """Two kinds of rows: one for each document, with the cost of its hot pairs; and its other pairs, by shard of the table,
    gathered over many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (hot_keys, hot_costs) = WordHashes(), hot.value
        base, before, done = TaskContext.get().partitionId() << 33, 0, 0
        keys, rows, held = [], [], 0
        partly = 0, 0

        def filled(n: int, columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _SCORED], schema=_SCORED)

        def requests() -> pa.RecordBatch:
            k, r = np.concatenate(keys), np.concatenate(rows)
            order = np.argsort(k, kind="stable")
            k, r = k[order], r[order]
            found = _by_shard(k, shards)
            columns = {"shard": pa.array([s for s, _, _ in found], pa.int32()), "keys": pa.array([packed_sorted(k[a:b]) for _, a, b in found], pa.binary()), "rows": pa.array([packed(r[a:b]) for _, a, b in found], pa.binary())}
            return filled(len(found), columns)

        for batch, own, parts, going, more in blocks(batches):
            p = pieces(parts)
            ids, owner = units(p, vocabulary.value)
            pair = pairs_of(ids, owner, before if going else 0)
            before = int(ids[-1]) if len(ids) else before if going else 0
            cost = np.zeros(len(pair), np.int64)
            rare = np.ones(len(pair), bool)
            if len(hot_keys) and len(pair):
                at = np.minimum(np.searchsorted(hot_keys, pair), len(hot_keys) - 1)
                rare = hot_keys[at] != pair
                cost = np.where(rare, 0, hot_costs[at])
            if rare.any():
                keys.append(pair[rare])
                rows.append((base + done + owner[rare]).astype(np.uint64))
                held += len(keys[-1])
            sums = np.append(np.int64(0), np.cumsum(cost))
            bounds = np.searchsorted(owner, np.arange(len(own) + 1))
            total, terms = sums[bounds[1:]] - sums[bounds[:-1]], p.terms
            if going:
                total[0] += partly[0]
                terms[0] += partly[1]
            if more:
                partly = int(total[0]), int(terms[0])
            else:
                counts = list(zip(*(counts_of(t, known) for t in (binaries(batch.column("text").slice(own[0], 1)) if going else parts)), strict=True))
                here = pa.array(own)
                columns = {"row": pa.array(base + done + np.arange(len(own))), "n_terms": pa.array(terms.astype(np.int64)), "cost": pa.array(total)} | {c: batch.column(c).take(here) for c in ("doc_id", "lang", "key")}
                columns |= {x.split()[0]: pa.array(c, pa.int64()) for x, c in zip(COUNTS.split(", "), counts, strict=True)}
                yield filled(len(own), columns)
                done += len(own)
            if held > HELD:
                yield requests()
                keys, rows, held = [], [], 0
        if held:
            yield requests()

    return run


def _answers(smoothing: Broadcast):
    """Rows sorted by shard, the table's first: the cost of each asking row's pairs in that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, costs = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for counts, keys, rows in zip(*(batch.column(c).to_pylist() for c in ("counts", "keys", "rows")), strict=True):
                if counts is not None:
                    table = unpacked_sorted(keys)
                    costs = smoothing.value.costs(table, unpacked(counts).astype(np.int64))
                    continue
                own = costs[np.searchsorted(table, unpacked_sorted(keys))]
                rows, cost = summed(unpacked(rows), own)
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), pa.array(cost)], ["row", "rare"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, text`` and ``key``, of language and text, whatever other columns there are."""
    lang = F.coalesce("lang", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.xxhash64(lang, "text").alias("key"), "text")


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, key``, the five counts, ``n_terms`` and ``bits`` (a run of letters) of every row."""
    model = Model(docs)
    schema = f"row long, doc_id long, lang string, key long, {COUNTS}, n_terms long, cost long, shard int, keys binary, rows binary"
    both = written(_keyed(docs).mapInArrow(_score(model.vocabulary, model.hot, model.shards), schema), "asked")
    asked = both.where("row is null").select("shard", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("counts"), "keys", "rows")
    known = model.table.select("shard", F.lit(0).alias("kind"), "counts", "keys", F.lit(None).cast("binary").alias("rows"))
    told = known.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    rare = told.mapInArrow(_answers(model.smoothing), "row long, rare long").groupBy("row").agg(F.sum("rare").alias("rare"))
    found = both.where("row is not null").drop("shard", "keys", "rows").join(rare, "row", "left")
    bits = F.round((F.col("cost") + F.coalesce("rare", F.lit(0))) / F.lit(1_000_000) / F.greatest("n_terms", F.lit(1)), 6)
    return written(found.select("doc_id", "lang", "key", *[x.split()[0] for x in COUNTS.split(", ")], "n_terms", F.when(F.col("n_terms") > 0, bits).alias("bits")), "scores")


def bands(scores: DataFrame) -> DataFrame:
    """``lang, median, below, above`` (bits): from an exact histogram in steps of 1/1000 bit over all documents that the
    base rules leave."""
    hist = scores.where(~_base_failed() & F.col("bits").isNotNull()).groupBy("lang", F.round(F.col("bits") * 1000).cast("long").alias("step")).agg(F.count("*").alias("n"))
    points = hist.groupBy("lang").agg(F.percentile("step", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    q = [F.element_at("q", i) / 1000 for i in (1, 2, 3)]
    return points.select("lang", q[1].alias("median"), F.greatest(F.lit(LEAST), WIDTH * (q[1] - q[0])).alias("below"), F.greatest(F.lit(LEAST), WIDTH * (q[2] - q[1])).alias("above"))


def _judged(docs: DataFrame) -> DataFrame:
    found = scored(docs)
    limits = written(bands(found), "bands").withColumnRenamed("lang", "_lang")
    rows = found.join(limits, F.col("lang") == F.col("_lang"), "left").withColumn("base_failed", _base_failed())
    wide = F.sqrt(1 + F.lit(SHORT) / F.greatest("n_terms", F.lit(1)))
    inside = (F.col("bits") >= F.col("median") - F.col("below") * wide) & (F.col("bits") <= F.col("median") + F.col("above") * wide)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits, kept`` of every row.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated 8-word windows. ``kept``: not so, and the bits
    a word lie within the language's bands; bands widen for short texts. Null text: no words, not kept. Null language: one
    of its own. Repeated rows are judged alike; ids play no part.
    """
    return _judged(docs).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "bits", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all columns. The rules look at language and text only, so rows are
    found again by a hash of both; null and repeated ids don't matter."""
    kept = written(_judged(docs).where("kept").select(F.col("key").alias("kept_key")).distinct(), "kept")
    key = F.xxhash64(F.coalesce("lang", F.lit("")), "text").alias("key")
    rows = docs.select(key, "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).where("text is not null")
    rows = rows.join(kept, F.col("key") == F.col("kept_key"), "left_semi")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
