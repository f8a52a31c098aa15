"""Substring dedup: passages that an earlier document holds too are cut out.

1. Anchors. Every document gives the least hash of each run of 35 consecutive 16-word phrases. Any 50 words that two
   documents share hold such a run, so they share an anchor. Anchors met in two different texts may recur.
2. Confirmed phrases. The words of these phrases are read from the texts that hold them, and those whose words two
   different texts hold are dealt to shards, by the smallest document that holds the phrase, so that a passage's phrases
   lie together.
3. Automata. One Aho-Corasick automaton over words (pyahocorasick) is compiled for each shard. Every document streams whole
   through the automata of all shards that it has an anchor of; a text without one shares no 50 words with any other, and no
   automaton could decide about it. Documents of a shard are dealt to several tasks, each with that shard's automaton.
4. Windows. A window of 50 words counts only where its own least phrase is a hit. Windows get digests of 128 bits (from
   two independent 64-bit hashes of each word); the smallest document of each is found, and in all other documents the
   window's words go.

Copies of a whole text are settled by their SHA-256.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import WordHashes, binaries, covered, drop_written, sliding_min, windows, written

SPAN, PHRASE = 50, 16
#: Phrases in a shard, about, and words that one task streams through a shard's automaton, about.
SHARD_PHRASES, TASK_WORDS = 50_000, 2_000_000
#: Partitions that shards and their tasks are dealt to, at most; beyond, a partition takes several of them in turn.
PARTITIONS = 20_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_EMPTY = hashlib.sha256(b"").hexdigest()


class _Other(WordHashes):
    """Hashes of words that are independent of the first ones."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 0x5EED)
        if len(word) <= 64:
            self[word] = h
        return h


def _phrases(hashes: np.ndarray) -> np.ndarray:
    return windows(hashes, PHRASE, 1)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        n, sha, anchors = [], [], []
        for text in binaries(batch.column("text")):
            words = text.split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).digest())
            anchors.append(np.empty(0, np.int64) if len(words) < SPAN else np.unique(sliding_min(_phrases(known.of(words)), SPAN - PHRASE + 1)).view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in anchors])]).astype(np.int32)
        flat = np.concatenate(anchors) if anchors else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), lists], ["doc_id", "h", "n_words", "sha", "anchors"])


def _words_of_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each anchor, once for each text that holds it."""
    known = WordHashes()
    for batch in batches:
        shards, phrases, owners = [], [], []
        for h, text, held in zip(batch.column("h").to_pylist(), binaries(batch.column("text")), batch.column("held"), strict=True):
            words = text.split()
            anchors, shard = (held.values.field(i).to_numpy() for i in range(2))
            found = _phrases(known.of(words)).view(np.int64)
            order = np.argsort(found, kind="stable")
            at = order[np.searchsorted(found[order], anchors)]
            phrases += [b" ".join(words[i : i + PHRASE]) for i in at.tolist()]
            shards += shard.tolist()
            owners += [h] * len(at)
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(phrases, pa.binary()), pa.array(owners, pa.int64())], ["shard", "phrase", "h"])


class Shard:
    """An automaton over the words of confirmed phrases; a word that is in none of them matches nothing.

    The library searches the children of a node one by one, and any word may begin a phrase, so a word is spelled in two
    characters of two alphabets: the automaton's root has at most 256 children, and no match begins within a word."""

    UNKNOWN = "\0\0"

    def __init__(self) -> None:
        self.codes: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        self.ready = self.empty = True

    def _code(self, word: bytes) -> str:
        found = self.codes.get(word)
        if found is None:
            n = len(self.codes)
            found = self.codes[word] = chr(1 + n % 256) + chr(0x10000 + n // 256)
        return found

    def add(self, phrase: bytes) -> None:
        self.automaton.add_word("".join(map(self._code, phrase.split())))
        self.ready = self.empty = False

    def hits(self, words: list[bytes]) -> np.ndarray:
        """Where the phrases begin in a text's words."""
        if self.empty:
            return np.empty(0, np.int64)
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        own = self.codes
        spelled = "".join([own.get(w, self.UNKNOWN) for w in words])
        return np.fromiter((e for e, _ in self.automaton.iter(spelled)), np.int64) // 2 - (PHRASE - 1)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and task, phrases first: the windows whose least phrase the shard's automaton finds."""
    one, two = WordHashes(), _Other()
    now, shard = None, Shard()
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        columns = [batch.column(c).to_pylist() for c in ("shard", "task", "phrase", "doc_id", "h")]
        for *key, phrase, doc_id, h, text in zip(*columns, binaries(batch.column("text")), strict=True):
            if key != now:
                now, shard = key, Shard()
            if phrase is not None:
                shard.add(phrase)
                continue
            words = text.split()
            hits = shard.hits(words)
            if not len(hits):
                continue
            hashes = one.of(words)
            phrases = _phrases(hashes)
            starts = np.flatnonzero(np.isin(sliding_min(phrases, SPAN - PHRASE + 1), phrases[hits]))
            values = (windows(hashes, SPAN, 0)[starts].view(np.int64), windows(two.of(words), SPAN, 1)[starts].view(np.int64), np.full(len(starts), doc_id, np.int64), np.full(len(starts), h, np.int64), starts.astype(np.int32))
            for o, v in zip(out, values, strict=True):
                o.append(v)
        arrays = [pa.array(np.concatenate(x) if x else np.empty(0, t), pa.from_numpy_dtype(t)) for x, t in zip(out, (np.int64,) * 4 + (np.int32,), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["w1", "w2", "doc_id", "h", "at"])


def _spans(starts: list[int], n: int) -> np.ndarray:
    return covered(np.array(starts, np.int64), SPAN, n)


def _kept_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for text, starts in zip(binaries(batch.column("text")), batch.column("starts").to_pylist(), strict=True):
            words = text.split()
            gone = _spans(starts, len(words))
            n.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "h", "n_removed", "kept_sha256"])


def cut(text: bytes, starts: list[int]) -> bytes:
    """The text without the words of the windows at ``starts`` (word numbers); white space before a word that goes
    goes with it, all else stays as it is."""
    spans = [m.span() for m in _WORD.finditer(text)]
    gone = _spans(starts, len(spans)).tolist()
    parts, at = [], 0
    for k, (_, end) in enumerate(spans):
        if not gone[k]:
            parts.append(text[at:end])
        at = end
    return b"".join([*parts, text[at:]])


def _text_key() -> Column:
    """With its doc_id, this stands for a row's text in joins, so rows of one doc_id never multiply."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


class Repeats:
    """What the search finds in rows ``doc_id, text, h`` (more columns may follow); frames over tables written once.

    ``every``: ``self.dealt`` has all rows; else only those that may hold a recurring passage.
    """

    def __init__(self, rows: DataFrame, every: bool) -> None:
        base = written(rows.select("doc_id", "h", "text").mapInArrow(_base, "doc_id long, h long, n_words long, sha binary, anchors array<long>"), "anchors")
        named = base.where(f"doc_id is not null and n_words >= {SPAN}")
        # Grouped sides are written before a join on their key: a side read from a table can be split where a key is hot.
        owners = named.groupBy("sha").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
        owners = written(owners.drop("last"), "owners")
        #: doc_id, h of texts that a smaller doc_id has too, word for word.
        self.copies = written(named.select("doc_id", "h", "sha").join(owners, "sha").where("doc_id > owner").select("doc_id", "h").distinct(), "copies")
        anchors = named.select("doc_id", "h", "n_words", F.explode("anchors").alias("anchor"))
        recurring = anchors.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.min("h").alias("a"), F.max("h").alias("b")).where("a != b")
        recurring = written(recurring.select("anchor", "first"), "recurring")
        shards = max(1, -(-recurring.count() // SHARD_PHRASES))
        shard = F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int").alias("shard")
        held = anchors.join(recurring, "anchor").groupBy("doc_id", "h", "n_words").agg(F.collect_set(F.struct("anchor", shard)).alias("held"))
        held = held.join(self.copies, ["doc_id", "h"], "left_anti")
        held = held.unionByName(self.copies.select("doc_id", "h", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<anchor:bigint,shard:int>>").alias("held")))
        held = held.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.lit(True).alias("touched"), "n_words", "held")
        held = written(held if every else held.where("held is not null"), "held")
        joined = rows.join(held, (F.col("doc_id") == F.col("_d")) & (F.col("h") == F.col("_h")), "left" if every else "inner")
        #: The rows, ``touched`` where a text is a copy or a candidate, ``held`` with a candidate's anchors and their shards.
        self.dealt = written(joined.drop("_d", "_h"), "dealt")
        candidates = self.dealt.where("held is not null").select("doc_id", "h", "text", "n_words", "held")
        for table in (owners, recurring, held):
            drop_written(table)
        found = written(self._streamed(candidates, shards), "windows")
        least = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
        least = written(least.drop("last"), "confirmed")
        hits = found.join(least, ["w1", "w2"]).where("doc_id > owner")
        #: doc_id, h, starts: windows whose words a document with a smaller doc_id has too.
        self.hits = written(hits.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("at")).alias("starts")), "hits")
        for table in (found, least):
            drop_written(table)
        self.base = base.drop("anchors")

    @staticmethod
    def _streamed(candidates: DataFrame, shards: int) -> DataFrame:
        sized = candidates.select("n_words", F.explode(F.array_distinct("held.shard")).alias("shard")).groupBy("shard").agg(F.sum("n_words").alias("n"))
        #: One row a shard: how many tasks stream documents through it.
        tasks = written(sized.select("shard", F.ceil(F.col("n") / TASK_WORDS).alias("tasks")), "shards")
        # A place of its own for the first task of each shard, the others in turn: by hash, or merged by bytes, several big
        # automata would share one Spark task.
        partitions = min(PARTITIONS, tasks.agg(F.sum("tasks")).first()[0] or 1)
        place = F.pmod(F.col("shard") + shards * F.col("task"), F.lit(partitions)).cast("int")
        words = candidates.mapInArrow(_words_of_anchors, "shard int, phrase binary, h long")
        confirmed = words.groupBy("shard", "phrase").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("shard", "phrase")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task")
        none = {"doc_id": "long", "h": "long", "text": "string"}
        phrases = confirmed.join(tasks, "shard").select("shard", every, "phrase", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
        texts = candidates.select("doc_id", "h", "text", F.explode(F.array_distinct("held.shard")).alias("shard")).join(tasks, "shard")
        texts = texts.select("shard", F.pmod(F.xxhash64("doc_id", "h"), F.col("tasks")).alias("task"), F.lit(None).cast("binary").alias("phrase"), *none)
        both = phrases.unionByName(texts).repartitionById(partitions, place).sortWithinPartitions("shard", "task", F.col("phrase").isNull())
        return both.mapInArrow(_located, "w1 long, w2 long, doc_id long, h long, at int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs`` (``doc_id, text``; other columns play no part).

    A window of 50 words goes from a document if the same words start in a document with a smaller doc_id; windows are
    judged on the input. Null and blank texts have no words. A row with a null doc_id is neither smaller nor larger than
    another and keeps all. Rows with one doc_id never cut each other. Repeated rows give repeated results; an empty table
    gives none.
    """
    found = Repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("h")), False)
    cut_rows = found.dealt.select("doc_id", "h", "text").join(found.hits, ["doc_id", "h"])
    fixed = cut_rows.mapInArrow(_kept_digest, "doc_id long, h long, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "h"])
    fixed = fixed.unionByName(found.copies.select("doc_id", "h", F.lit(None).cast("long").alias("n_removed"), F.lit(_EMPTY).alias("kept_sha256")))
    fixed = fixed.select(F.col("doc_id").alias("d"), F.col("h").alias("_h"), F.col("n_removed").alias("n"), F.col("kept_sha256").alias("k"))
    rows = found.base.join(written(fixed, "fixed"), (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("_h")), "left")
    n = F.when(F.col("d").isNull(), F.lit(0)).otherwise(F.coalesce("n", "n_words"))
    return rows.select("doc_id", "n_words", n.cast("long").alias("n_removed"), F.coalesce("k", F.lower(F.hex("sha"))).alias("kept_sha256"))


@F.pandas_udf(StringType())
def _cut_texts(texts, starts):  # noqa: ANN001, ANN202
    return type(texts)([cut(t.encode(), list(s)).decode() for t, s in zip(texts, starts, strict=True)], dtype=object)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of its texts (see :func:`cut`) and ``n_chars``, if there is such a column,
    set anew; a text that goes as a whole is empty, white space apart. All rows and columns stay, whatever their names;
    nulls, repeated rows and empty tables as in :func:`repeated_passages`."""
    nested = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    found = Repeats(nested, True)
    touched = found.dealt.where("touched").select("doc_id", "h", "text", "row", F.col("held").isNull().alias("copy"))
    touched = touched.join(found.hits, ["doc_id", "h"], "left")
    new = F.when(F.col("copy"), F.lit("")).when(F.col("starts").isNull(), F.col("text")).otherwise(_cut_texts("text", F.coalesce("starts", F.array().cast("array<int>"))))
    changed = F.col("copy") | F.col("starts").isNotNull()
    out = touched.select("row", new.alias("text"), changed.alias("changed")).unionByName(found.dealt.where("touched is null").select("row", "text", F.lit(False).alias("changed")))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("changed"), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c)
        return F.col("row").getField(c).alias(c)

    return out.select(*map(column, docs.columns))
