"""SimHash near-duplicates: 64-bit fingerprints, linked where few bits differ, found by covering hashing.

R. Pagh, "Locality-sensitive hashing without false negatives" (SODA 2016): give every bit a vector of r + 1 bits;
the mask of a non-zero vector v keeps the bits whose vector has an odd product with v. At most r vectors always have a
non-zero v that is orthogonal to all of them, so fingerprints that differ in at most r bits agree under at least one of the 2^(r+1) - 1 masks, so every pair within the radius meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import counted, dealt, groups, join_groups, sorted_lists
from .common import WordHashes, binaries, mixed, windows, written
from .components import connected_components

RADIUS = 3
#: A bucket of more fingerprints is spread over the masks once more, by the bits that its own mask leaves out.
LARGE = 4_096
SEED = 42
#: Of the pipeline's stage: words in a shingle, least Jaccard similarity, and MinHash bands of so many rows that bring
#: texts together (a pair at a similarity of 0.8 misses all bands with a probability of 0.000003).
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 4
#: Texts, and their shingles, that are compared with others in one task, about.
BLOCK, BLOCK_SHINGLES = 2_048, 1_000_000
_TURNS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; vectors are dealt to the bits in turn, so each mask keeps about half of them."""
    span = (1 << (radius + 1)) - 1
    vectors = [1 + (i * 7) % span for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, span + 1)]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is set if it is set in over half the XXH64 hashes (seed 42) of the text's shingles."""
    words = text.lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - shingle]])
    hash_of = xxhash.xxh64_intdigest
    hashes = [hash_of(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    n, counts = len(hashes), np.zeros(64, np.int64)
    h = np.array(hashes, "<u8")
    for i in range(0, n, 65_536):
        counts += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist()))


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in binaries(batch.column("text"))], np.uint64).view(np.int64)
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], [*kept, "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (the 64 bits as a signed number) of every row; null text: zero."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprinted, "doc_id long, fingerprint long")


def _near(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join the values within the radius as far as these values alone do, each group to its least one."""
    n = len(values)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(0, n, 1024):
        rows = values[i : i + 1024, None] ^ values[None, i:]
        a, b = np.nonzero(np.bitwise_count(rows) <= radius)
        for x, y in zip((a + i)[a < b].tolist(), (b + i)[a < b].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(i, r) for i in range(n) if (r := root(i)) != i]


def _edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, np.ndarray] | None = None

        def emit(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            a, b = [], []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                own = np.unique(values[s:e])
                for x, y in _near(own.view(np.uint64), radius):
                    a.append(own[x])
                    b.append(own[y])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            values = batch.column(3).to_numpy()
            if rest is not None:
                keys, values = np.concatenate([rest[0], keys]), np.concatenate([rest[1], values])
            same = np.all(keys == keys[-1], axis=1)
            last = len(keys) - (int(np.argmin(same[::-1])) if not same.all() else len(keys))
            if last:
                yield emit(keys[:last], values[:last])
            rest = keys[last:], values[last:]
        if rest is not None:
            yield emit(*rest)

    return run


def covering_edges(distinct: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """distinct: one column ``fp`` without repeats. Edges ``a, b`` that join all fingerprints within the radius;
    in a bucket only a spanning forest is given out, so edges never outnumber bucket entries."""
    masks = covering_masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64))).alias("key")) for i, m in enumerate(masks)]))
    first = distinct.select("fp", table.alias("x")).select("x.t", "x.key", "fp")
    full = first.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    full = written(full, "buckets")
    first = first.join(full, ["t", "key"])
    # A pair in a large bucket differs outside its mask only, so the masks cover it again there.
    finer = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("sub"), F.xxhash64(F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64)))).alias("rest")) for i, m in enumerate(masks)])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("sub"), F.lit(0).cast("long").alias("rest")))
    dealt = first.select("t", "key", "fp", F.explode(F.when(F.col("n") > large, finer).otherwise(whole)).alias("y"))
    dealt = dealt.select((F.col("t") * 64 + F.col("y.sub")).cast("long").alias("t"), "key", F.col("y.rest").alias("rest"), "fp")
    dealt = dealt.repartition("t", "key", "rest").sortWithinPartitions("t", "key", "rest")
    return dealt.mapInArrow(_edges(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` of every row: the smallest doc_id that links of at
    most ``radius`` differing bits reach, itself included.

    Texts without a word, null ones included, have fingerprint zero and link like others. Rows with a null doc_id
    are nodes too but never name a component (a component of such rows alone has a null id); repeated rows stay
    repeated; an empty table gives no rows. Equal fingerprints are one node, so copies never meet each other.
    """
    rows = written(fingerprints(docs), "fingerprints")
    edges = covering_edges(rows.select(F.col("fingerprint").alias("fp")).distinct(), radius)
    roots = connected_components(edges)
    rooted = rows.join(roots, F.col("fingerprint") == F.col("node"), "left").select("doc_id", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = written(least, "components")  # a side of its own, so that a hot component can be split
    out = rooted.join(least, "root")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the different five-word shingles; a shorter text is one shingle."""
    h = known.of(text.lower().split())
    return np.unique(windows(h, min(SHINGLE, len(h))) if len(h) else np.zeros(1, np.uint64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        bands = np.zeros((batch.num_rows, BANDS), np.uint64)
        for i, text in enumerate(binaries(batch.column("text"))):
            h, least = shingles(text, known), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
            for s in range(0, len(h), 1_024):
                least = np.minimum(least, mixed(h[s : s + 1_024, None] * _TURNS).min(axis=0))
            for row in least.reshape(BANDS, ROWS).T:
                bands[i] = mixed(bands[i] * np.uint64(0x9E3779B97F4A7C15) + row)
        column = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.ravel().view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("node"), column], ["node", "bands"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = [shingles(t, known).view(np.int64) for t in binaries(part.column("text"))]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "shingles"])


def similar_edges(docs: DataFrame) -> DataFrame:
    """Edges ``a, b`` between texts (by XXH64), so many that their components are those of all pairs that share a MinHash
    band and have a Jaccard similarity of SIMILAR or more, computed exactly. The members of a bucket are first compared
    with its least one; other pairs only where that left a bucket in several components."""
    texts = docs.select(F.xxhash64("text").alias("node"), "text")
    signed = texts.mapInArrow(_signed, "node long, bands array<long>").groupBy("node").agg(F.first("bands").alias("bands"))
    members = signed.select("node", F.posexplode("bands").alias("band", "key"))
    least = members.groupBy("band", "key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(members.join(least, ["band", "key"]), "members")
    wanted = written(members.select("node").distinct(), "wanted")
    sets = texts.join(wanted, "node", "left_semi").mapInArrow(_shingled, "node long, shingles array<long>")
    sets = written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")
        both = pairs.distinct().join(one, "a").join(two, "b").withColumn("_n", F.size(F.array_intersect("_a", "_b")))
        return both.where(F.col("_n") >= SIMILAR * (F.size("_a") + F.size("_b") - F.col("_n"))).select("a", "b")

    stars = written(confirmed(members.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))), "stars")
    roots = connected_components(stars)
    members = members.join(roots, "node", "left").select("band", "key", "node", "least", F.coalesce("root", "node").alias("root"))
    open_ = members.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "key")
    rest = written(members.join(open_, ["band", "key"]).select("node", "least").distinct(), "open")
    # Texts that buckets left in several components hold, by what buckets join: compared in blocks, and only edges written.
    loose = connected_components(rest.select(F.col("least").alias("a"), F.col("node").alias("b")))
    grouped = rest.select("node").distinct().join(loose, "node", "left").select(F.coalesce("root", "node").alias("key"), F.col("node").alias("id"))
    grouped = grouped.join(sets.select(F.col("node").alias("id"), "shingles"), "id")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES))
    return stars.unionByName(dealt(grouped, blocks).mapInArrow(_compared, "a long, b long"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join the texts of two blocks as far as their similarity does, each text to the least of its group."""
    for (_, one, two), rows in groups(batches):
        if rows.num_rows < 2:
            continue
        ids, block = rows.column("id").to_numpy(), rows.column("block").to_numpy()
        own = rows.column("shingles").combine_chunks()
        sizes = np.diff(own.offsets.to_numpy())
        value, row = own.values.to_numpy()[own.offsets[0].as_py() : own.offsets[-1].as_py()], np.repeat(np.arange(len(ids)), sizes)
        a = np.flatnonzero(block == one)
        b = a if one == two else np.flatnonzero(block == two)
        at = np.full(len(ids), -1)
        at[b] = np.arange(len(b))
        inside = at[row] >= 0
        vb, rb = sorted_lists(value[inside], at[row][inside])
        root = np.arange(len(ids))
        for s in range(0, len(a), 256):
            part = a[s : s + 256]
            place = np.full(len(ids), -1)
            place[part] = np.arange(len(part))
            inside = place[row] >= 0
            n = counted(*sorted_lists(value[inside], place[row][inside]), len(part), vb, rb, len(b))
            i, j = np.nonzero(n >= SIMILAR * (sizes[part][:, None] + sizes[b][None, :] - n))
            join_groups(root, part[i], b[j])
        found = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[root[found]]), pa.array(ids[found])], ["a", "b"])


def keep_dissimilar(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group that links of a similarity of SIMILAR or more join (five-word shingles):
    the one with the smallest doc_id; ids as in :func:`keep_one`. Null texts are empty ones, and those are alike."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    roots = connected_components(similar_edges(own))
    rows = own.select("doc_id", F.xxhash64("text").alias("h"))
    rows = rows.join(roots, F.col("h") == F.col("node"), "left").select("doc_id", "h", F.coalesce("root", "h").alias("root"))
    return _one_of_each(docs, written(rows, "rooted"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component of :func:`near_duplicates`: the one with the smallest doc_id. Of unlike
    texts with one doc_id each counts for its own component; of several rows of a component with its smallest doc_id one
    stays. Rows with a null doc_id can't be told apart and stay. An empty table stays empty."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(own.withColumn("h", F.xxhash64("text")).mapInArrow(_fingerprinted, "doc_id long, h long, fingerprint long"), "fingerprints")
    roots = connected_components(covering_edges(rows.select(F.col("fingerprint").alias("fp")).distinct(), radius))
    rows = rows.join(roots, F.col("fingerprint") == F.col("node"), "left").select("doc_id", "h", F.coalesce("root", "fingerprint").alias("root"))
    return _one_of_each(docs, written(rows, "rooted"))


def keep_unlike(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group that links of :func:`near_duplicates` (SimHash fingerprints that differ in at most
    ``radius`` bits) and those of :func:`keep_dissimilar` (an exact similarity) join: the one with the smallest doc_id; ids as in
    :func:`keep_one`. A group may need links of both kinds, so all are joined at once: texts of one fingerprint by their least
    hash, which stands for the fingerprint in its links."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(own.withColumn("h", F.xxhash64("text")).mapInArrow(_fingerprinted, "doc_id long, h long, fingerprint long"), "fingerprints")
    near = rows.select("h", "fingerprint").distinct()
    least = written(rows.groupBy("fingerprint").agg(F.min("h").alias("least")), "least")
    edges = near.join(least, "fingerprint").where("h != least").select(F.col("least").alias("a"), F.col("h").alias("b"))
    one, two = (least.select(F.col("fingerprint").alias(x), F.col("least").alias(f"_{x}")) for x in "ab")
    links = covering_edges(least.select(F.col("fingerprint").alias("fp")), radius).join(one, "a").join(two, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    roots = connected_components(edges.unionByName(links).unionByName(similar_edges(own)))
    rows = rows.join(roots, F.col("h") == F.col("node"), "left").select("doc_id", "h", F.coalesce("root", "h").alias("root"))
    return _one_of_each(docs, written(rows, "rooted"))


def _one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: ``doc_id, h`` (of the text), ``root`` of every row of ``docs``."""
    named = rows.where("doc_id is not null")
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("x")).select("x.doc_id", "x.h")
    times = named.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    kept = written(least.join(times, ["doc_id", "h"]).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "n"), "kept")
    nested = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = nested.join(kept, (F.col("doc_id") == F.col("_d")) & (F.col("h") == F.col("_h")))
    out = found.where("n = 1").select("row").unionByName(nested.where("doc_id is null").select("row"))
    if kept.where("n > 1").head(1):  # of repeated rows the one with the least hash
        out = out.unionByName(found.where("n > 1").groupBy("doc_id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
