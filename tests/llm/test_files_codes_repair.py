"""Operators 11 to 13 against plain Python on whole small tables, and on awkward rows."""

import hashlib
import math
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslens.llm import conversations, queries, token_files, vector_codes, wordbpe

TEXTS = [
    (7, "One two, three."), (7, "One two, three."), (7, "Another"), (None, "null's key"), (None, None), (-3, ""), (-4, " \t\n "), (2**40, "été naïve <|endoftext|> 漢字 x<|startoftext|>y  tab\tend "),
    (5, "İ. Σίσυφος. क़. é. don't I'll 12.5% ﬁ…"), (6, "a\x85b\xa0c d ̸= \x1c q"), (8, "long" + "g" * 20_000), (9, "word, " * 300_000), (1, "x́. ы́, ß; ﷽!"), (0, "\x00 nul"),
]


def plain(texts):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [model.encode(t or "", add_special_tokens=False).ids for t in texts]


def corpus_of(rows):
    """Documents in the order of keys, nulls first, with starts; equal keys may stand in any order."""
    out = sorted(((k is not None, k or 0), ids + [1]) for (k, _), ids in zip(rows, plain([t for _, t in rows]), strict=True))
    return out


def test_word_encoder():
    texts = [t or "" for _, t in TEXTS]
    assert [np.frombuffer(wordbpe.encoder().ids(t), "<u4").tolist() for t in texts] == plain(texts)
    small = wordbpe.WordEncoder("word_bpe_49k.json", 20)
    small.AT_ONCE = 50  # forgets all the time, cuts long texts
    assert [np.frombuffer(small.ids(t), "<u4").tolist() for t in 2 * texts] == 2 * plain(texts)


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in TEXTS], "doc_id long, text string, ids string, shard int").repartition(3)
    manifest = token_files.write(docs, f"file://{tmp_path}/corpus")
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    keys = [(r.key is not None, r.key or 0) for r in got]
    assert keys == sorted(keys)
    assert sorted((k, r.ids) for k, r in zip(keys, got, strict=True)) == corpus_of(TEXTS)
    # the files by themselves
    shards = sorted(manifest.collect(), key=lambda r: r.shard)
    ids = np.concatenate([np.fromfile(tmp_path / f"corpus/ids-{s.name}.bin", "<u2") for s in shards])
    assert ids.tolist() == [x for r in got for x in r.ids]
    edges = [np.fromfile(tmp_path / f"corpus/offsets-{s.offsets}.bin", "<u8") for s in shards]
    assert edges[0][0] == 0 and edges[-1][-1] == len(ids) and all(a[-1] == b[0] for a, b in zip(edges, edges[1:], strict=False))
    assert [x for e in edges for x in e[:-1].tolist()] == [r.start for r in got]
    assert sum(s.n_null for s in shards) == 2


def test_token_files_are_dealt_apart(spark):
    """A key that all rows have does not make one shard."""
    docs = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t "), "id")).alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1 and manifest.agg(F.max("n_docs")).first()[0] < 1500
    assert token_files.read(manifest).count() == 2000


def test_token_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = token_files.write(docs)
    assert manifest.count() == 0 and token_files.read(manifest).count() == 0


def test_op11(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    start, want = 0, {}
    for (_, k), ids in corpus_of(rows):
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = queries.op11_token_files(spark, sf_dir)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.collect()} == want


def coded(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: key, label, vector. Plain whole numbers, one vector at a time."""
    rows = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    rows = [r for r in rows if len(r[2]) == len(rows[0][2])]
    if not rows:
        return {}, None
    width = -(-len(rows[0][2]) // parts)
    from fractions import Fraction

    cut = []
    for _, _, v in rows:
        n = [math.floor(Fraction(x) * scale) for x in v]
        n += [0] * (width * parts - len(n))
        cut.append([n[p * width : (p + 1) * width] for p in range(parts)])
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for v in cut:
                own[near(v[p], book)[1]].append(v[p])
            new.append([[sum(x) // len(g) for x in zip(*g, strict=True)] if g else e for g, e in zip(own, book, strict=True)])
        books = new
    out, sums = [], {}
    for (key, label, _), v in zip(rows, cut, strict=True):
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((key, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
        sums[label] = sums.get(label, 0) + out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(k), c, min(e, 2**63 - 1), sums[lab]) for k, lab, c, e in out), sha


def compressed(frame, **more):
    done = vector_codes.compress(frame, "vec_id", "embedding", "label", **more)
    rows = vector_codes.digest(done).collect()
    return sorted((str(r.key), r.code, r.error, r.label_error) for r in rows), {r.codebooks_sha256 for r in rows}


SCHEMA = "vec_id long, embedding array<float>, label int, key string, code int"


@pytest.mark.parametrize("length", [16, 13, 3])
def test_vector_codes(spark, length):
    rng = np.random.default_rng(length)
    vectors = rng.normal(size=(300, length)).astype(np.float32).astype(float)
    rows = [(i if i % 50 else None, v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(vectors)]
    rows += [(-9, None, 1), (-8, [None] * length, 1), (-7, [math.nan] * length, 1), (-6, [math.inf] + [0.0] * (length - 1), None), (-5, [0.5] * (length + 1), 2), (-5, [-0.0] * length, 2), (17, vectors[17].tolist(), 2), (17, vectors[18].tolist(), 2)] + [(1000 + i, vectors[5].tolist(), 0) for i in range(40)]
    rows = [r for r in rows if r[0] != -5 or len(r[1]) == length] + [(400, [1.0] * (length + 1), 2)]
    want, sha = coded([[k, lab, v] for k, v, lab in rows])
    frame = spark.createDataFrame([(k, v, lab, "x", 0) for k, v, lab in rows], SCHEMA).repartition(5)
    assert compressed(frame) == (want, {sha})


def test_vector_codes_of_large_numbers(spark):
    """Components whose squares don't fit 64 bits are worked out exactly."""
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(40, 8)) * 10.0 ** rng.integers(-3, 12, (40, 8))).tolist()
    rows = [(i, v, None) for i, v in enumerate(vectors)] + [(100, [1e300] + [0.0] * 7, 1)]
    done = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label")
    want, sha = coded([[k, lab, v] for k, v, lab in rows])
    assert sorted((str(r.key), "".join(f"{x:02x}" for x in r.code), r.error) for r in done.rows.collect()) == [x[:3] for x in want] and done.books.sha256() == sha


def test_vector_codes_of_few_and_none(spark):
    few = spark.createDataFrame([(2, [0.25, 1.0], None, "", 0), (1, [0.5, -1.0], None, "", 0)], SCHEMA)
    want, sha = coded([[2, None, [0.25, 1.0]], [1, None, [0.5, -1.0]]])
    assert compressed(few) == (want, {sha})
    assert compressed(few.where("false")) == ([], set())
    assert compressed(few.withColumn("embedding", F.lit(None).cast("array<float>"))) == ([], set())
    assert compressed(few.withColumn("embedding", F.array().cast("array<float>")))[0] == [("1", "00" * 8, 0, 0), ("2", "00" * 8, 0, 0)]


def test_vector_codes_decode(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    done = vector_codes.compress(frame, "vec_id", "embedding", "label")
    back = {r.key: r.vector for r in vector_codes.decode(done.rows, done.books).collect()}
    for r in done.rows.join(frame, F.col("key") == F.col("vec_id")).limit(50).collect():
        far = sum((math.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(r.embedding, back[r.key], strict=True))
        assert far == r.error


def test_op12(spark, sf_dir):
    rows = [[r.vec_id, r.label, r.embedding] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, sha = coded(rows)
    got = queries.op12_vector_codes(spark, sf_dir)
    assert got.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = got.collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want and {r.codebooks_sha256 for r in got} == {sha}


def next_state(state, initial):
    return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)


def cheapest(turns):
    """turns: (initial, fault). Least (cost, audit) by costs that are relaxed until nothing changes."""
    n = len(turns)

    def edits(i, q):
        if i < n:
            initial, fault = turns[i]
            yield "D", 3, i + 1, q
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if next_state(q, initial):
                    yield "K", extra, i + 1, next_state(q, initial)
                for x in "ua":
                    if next_state(q, x):
                        yield "R", 2 + extra, i + 1, next_state(q, x)
        for x in "ua":
            if next_state(q, x):
                yield "I", 2, i, next_state(q, x)

    far = {(i, q): 0 if i == n and q in ("", "a") else math.inf for i in range(n + 1) for q in ("", "s", "u", "a")}
    changed = True
    while changed:
        changed = False
        for i in range(n, -1, -1):
            for q in ("", "s", "u", "a"):
                least = min([far[i, q], *(c + far[j, r] for _, c, j, r in edits(i, q))])
                changed |= least < far[i, q]
                far[i, q] = least

    @cache
    def letters(i, q):
        ends = [""] if far[i, q] == 0 and i == n else []
        return min(ends + [x + letters(j, r) for x, c, j, r in edits(i, q) if c + far[j, r] == far[i, q] and (c or j > i)])

    return far[0, ""], letters(0, "")


def judged(rows):
    """rows of one conversation after damage: (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        turns.append((role[:1], fault))
        if fault:
            count[fault] += 1
    cost, audit = cheapest(tuple(turns))
    left, q, out = iter(rows), "", []
    initials = iter(turns)
    for x in audit:
        if x == "I":
            q = next(c for c in "ua" if next_state(q, c))
            out.append(("user" if q == "u" else "assistant") + ":")
            continue
        (_, role, text), (initial, _) = next(left), next(initials)
        if x == "K":
            q = next_state(q, initial)
            out.append(f"{role}:{text}")
        if x == "R":
            q = next(c for c in "ua" if next_state(q, c))
            out.append(("user:" if q == "u" else "assistant:") + text)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), "\n".join(out)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_cost_layers():
    repairs, rng = conversations.Repairs(), np.random.default_rng(3)
    names = {"B": "blank", "D": "duplicate", "T": "truncated", "-": None}
    for _ in range(1500):
        codes = rng.choice(16, rng.integers(0, 9), p=np.tile([0.03, 0.03, 0.06, 0.13], 4)).astype(np.uint8).tobytes()
        assert repairs.audit(codes) == cheapest(tuple((conversations.CODES[c][0], names[conversations.CODES[c][1]]) for c in codes))
    cost, audit = repairs.audit(b"\x07" * 200_000 + b"\x03")  # a very long conversation takes a step a turn
    assert len(audit) >= 200_001 and cost > 0
    assert len(repairs.layers) < 200


def test_awkward_conversations(spark):
    rng = np.random.default_rng(8)
    texts, roles = ["Yes.", "no", "", " \t\x0b", None, "Was?\x0c ", "\xa0", "Été! ", "漢", "a\x1c."], ["user", "assistant", "system", "tool", "", None, "umbrella", "étoile"]
    rows = [(int(c) if c else None, int(t) if t < 6 else None, roles[r], texts[x]) for c, t, r, x in zip(rng.integers(0, 60, 500), rng.integers(0, 7, 500), rng.choice(8, 500, p=[0.3, 0.3, 0.1, 0.06, 0.06, 0.06, 0.06, 0.06]), rng.integers(0, 10, 500), strict=True)]
    rows += [(77, 0, "user", "Same.")] * 30
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, here string, place int").repartition(4)
    want = {c: judged(r) for c, r in damaged(rows).items()}
    checked = conversations.check(conversations.damage(frame))
    got = conversations.digests(checked).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == {c: w[:8] for c, w in want.items()} and len(got) == len(want)
    turns = {}
    for r in sorted(conversations.repaired(checked).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: "\n".join(t) for c, t in turns.items()} == {c: w[8] for c, w in want.items() if w[8]}


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    checked = conversations.check(conversations.damage(none))
    assert conversations.digests(checked).count() == conversations.repaired(checked).count() == 0


def test_op13(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = queries.op13_conversation_repair(spark, sf_dir)
    assert got.columns[:9] == ["conv_id", *COLUMNS]
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got.collect()} == {c: judged(r)[:8] for c, r in damaged(rows).items()}
