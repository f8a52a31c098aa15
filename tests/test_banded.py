"""Signatures, banded clusters and comparisons, dense numbers and the kept index, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.config import DEFAULT
from corpuslens.functions import kernels
from corpuslens.functions import text as T
from corpuslens.operators import compare, numbering, similarity, stars
from corpuslens.streaming.kept_index import KeptIndex

ODD = ["", None, "! ! ! !", "é", "x-y   z", "a\xa0b\x1cc d\x85e", "Two words", "KK İx yes", "漢字 漢字 漢字", "a" * 300, "- - - -", "\n\n\t", "x" * 5 + "   y z w", " ! a", "ab"]


def plain_signature(text):
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:7], 16)
    found = kernels.shingle_set(text)
    return tuple(min(((number(f"a{k}") + 1) * number(s) + number(f"b{k}")) % ((1 << 31) - 1) for s in found) for k in range(128)) if found else None


def test_kernel_agrees_with_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).select(F.col("doc_id").alias("file_index"), F.col("text").alias("content"))
    odd = spark.createDataFrame(list(enumerate(ODD, 10_000)), "file_index long, content string")
    files = docs.unionByName(odd)
    from dataclasses import replace

    config = replace(DEFAULT, min_chars=0)
    sets = files.where("content is not null").select("file_index", T.shingles(F.col("content")).alias("sh"))
    want = {r.file_index: r.sig for r in similarity.signatures(sets).collect()}
    assert {r.file_index: r.sig for r in kernels.signatures(files, config).collect()} == want
    raw = {r.file_index: bytes(r.sig) for r in kernels.signatures(files, config, raw=True).collect()}
    assert raw == {k: b"".join(x.to_bytes(4, "little") for x in v) for k, v in want.items()}
    assert want[10_006] == list(plain_signature("Two words"))


def made(n, seed):
    """Texts in families of near copies, copies and strangers."""
    rng = random.Random(seed)
    families = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(max(2, n // 6))]
    out = []
    for i in range(n):
        words = list(families[rng.randrange(len(families))])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(words)))
    return out


def bands(sig):
    return {(k, sig[5 * k : 5 * k + 5]) for k in range(25)}


def plain_stars(sigs):
    """Clusters of the files in order: seed and all candidates."""
    met = {i: {j for j in sigs if bands(sigs[i]) & bands(sigs[j])} for i in sigs}
    taken, out = set(), []
    for i in sorted(sigs):
        if i not in taken and len(met[i]) > 1:
            out.append(met[i])
            taken |= met[i]
    return out


def estimate(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / 128


@pytest.mark.parametrize("seed", [1, 2])
def test_banded_clusters(spark, seed):
    texts = made(120, seed) + [(1000 + i, "same text " * 30) for i in range(40)]
    sigs = {i: plain_signature(t) for i, t in texts}
    want = plain_stars(sigs)
    frame = kernels.signatures(spark.createDataFrame(texts, "file_index long, content string").repartition(3), raw=True)
    got = stars.members(frame)
    clusters = {}
    for r in got.collect():
        clusters.setdefault(r.cluster_id, set()).add(r.file_index)
    assert [clusters[k] for k in sorted(clusters)] == want and sorted(clusters) == list(range(len(want)))
    assert sum(map(len, clusters.values())) == got.count()
    means = {r.cluster_id: r.mean for r in stars.slot_means(got, frame).collect()}
    for k, members in enumerate(want):
        pairs = [estimate(sigs[a], sigs[b]) for a in members for b in members if a < b]
        assert means[k] == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)
    pairs = stars.member_pairs(got, frame).collect()
    assert all(r.similarity == estimate(sigs[r.file1_index], sigs[r.file2_index]) for r in pairs)
    assert len(pairs) == sum(len(m) * (len(m) - 1) // 2 for m in want)


def test_large_groups_make_no_pairs(spark):
    """20,000 copies cost rows in proportion, in clusters, in their means and in comparisons."""
    n = 20_000
    sig = kernels.signatures(spark.createDataFrame([(0, made(1, 1)[0][1])], "file_index long, content string"), raw=True).first().sig
    frame = spark.range(n).select(F.col("id").alias("file_index"), F.lit(bytes(sig)).alias("sig")).repartition(4)
    got = stars.members(frame)
    assert got.count() == n and stars.slot_means(got, frame).first().mean == 1.0
    best = stars.best_candidates(frame.where("file_index % 2 = 0"), frame.where("file_index % 2 = 1"))
    assert best.agg(F.count("*").alias("n"), F.max("i").alias("i"), F.min("jaccard").alias("s")).first() == (n // 2, 0, 1.0)


@pytest.mark.parametrize("block", [512, 3])
def test_best_candidates(spark, monkeypatch, block):
    monkeypatch.setattr(stars, "BLOCK", block)  # blocks of three: every bucket is cut
    texts = made(150, 5)
    texts += [(i + 500, t) for i, t in texts[:30]]
    sigs = {i: plain_signature(t) for i, t in texts}
    frame = kernels.signatures(spark.createDataFrame(texts, "file_index long, content string"), raw=True)
    left, right = frame.where("file_index % 3 = 0"), frame.where("file_index % 3 > 0")
    want = {}
    for j in sigs:
        met = [(estimate(sigs[i], sigs[j]), -i) for i in sigs if i % 3 == 0 and j % 3 and bands(sigs[i]) & bands(sigs[j])]
        if met:
            want[j] = (max(met)[0], -max(met)[1])
    assert {r.j: (r.jaccard, r.i) for r in stars.best_candidates(left, right).collect()} == want
    v = compare.venn(left, right, banded=True).first()
    assert (v.shared, v.shared_a, v.total_a + v.total_b) == (len(want), len({i for _, i in want.values()}), len(sigs))
    matches = {r.file_index: (r.status, r.similar_to) for r in compare.best_matches(right, left, banded=True).collect()}
    for j, found in matches.items():
        s, i = want.get(j, (0, None))
        assert found == (("redundant" if s >= 0.9 else "partial", i) if s >= 0.7 else ("novel", None))
    assert compare.venn(left.where("false"), right, banded=True).first().verdict == "empty"


def test_numbers_are_dense(spark):
    rows = [(random.Random(3).randrange(10**9) + i, f"k{i % 7}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "x long, k string").repartition(7)
    got = numbering.numbered(frame, ["k", F.desc("x")], "id")
    assert [(r.x, r.k) for r in got.orderBy("id").collect()] == sorted(rows, key=lambda r: (r[1], -r[0]))
    assert sorted(r.id for r in got.collect()) == list(range(1000))
    assert numbering.numbered(frame.where("false"), ["k"], "id").count() == 0
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_kept_index_in_batches(spark, tmp_path):
    """Ten batches, out of order and with files that come again, leave the clusters that one batch leaves."""
    texts = made(150, 9)
    random.Random(4).shuffle(texts)
    sigs = {i: plain_signature(t) for i, t in texts}
    index = KeptIndex(spark, f"{tmp_path}/ten")
    for n in range(10):
        part = texts[15 * n : 15 * n + 15] + texts[:2] + [(9000 + n, "short")]
        index.add(spark.createDataFrame(part, "file_index long, content string"), n)
        if n == 4:  # a batch that is run again changes nothing
            index.add(spark.createDataFrame(part, "file_index long, content string"), n)
            so_far = {i: sigs[i] for i, _ in texts[:75]}
            assert {(min(m), i) for m in plain_stars(so_far) for i in m} != set()
            assert {frozenset(m) for m in clusters_of(index)} == {frozenset(m) for m in plain_stars(so_far)}
    want = plain_stars(sigs)
    assert clusters_of(index) == want
    one = KeptIndex(spark, f"{tmp_path}/one")
    one.add(spark.createDataFrame(texts, "file_index long, content string"), 0)
    assert clusters_of(one) == want
    # what a batch didn't touch stays in the tables of its own batch
    assert index._living("stars").select("batch").distinct().count() > 3
    best = index.probe(spark.createDataFrame([(7, texts[3][1]), (8, "nothing like it " * 20)], "file_index long, content string")).collect()
    assert [(r.j, r.jaccard) for r in best] == [(7, 1.0)]


def clusters_of(index):
    out = {}
    for r in index.members().collect():
        out.setdefault(r.cluster_id, set()).add(r.file_index)
    return [out[k] for k in sorted(out)]


def test_kept_index_follows_a_stream(spark, tmp_path):
    texts = made(30, 2)
    source = str(tmp_path / "in")
    index = KeptIndex(spark, str(tmp_path / "index"))
    for part in (texts[:20], texts[20:]):
        spark.createDataFrame(part, "file_index long, content string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("file_index long, content string").parquet(source)
        index.follow(stream, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert clusters_of(index) == plain_stars({i: plain_signature(t) for i, t in texts})


def test_pairs_of_a_cluster_are_compared_in_blocks(spark, monkeypatch):
    """Signatures meet once a block, not once a pair; every pair comes once."""
    monkeypatch.setattr(stars, "BLOCK", 4)
    rng = np.random.default_rng(3)
    sigs = {i: rng.integers(0, 3, DEFAULT.slots).astype("<u4") for i in range(23)}
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sigs.items()], "file_index long, sig binary")
    held = {7: range(15), 8: range(10, 23), 9: [3, 20]}
    clusters = spark.createDataFrame([(c, i) for c, own in held.items() for i in own], "cluster_id long, file_index long").repartition(3)
    pairs = stars.member_pairs(clusters, frame)
    assert "MapInArrow" in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = {(c, i, j): float((sigs[i] == sigs[j]).mean()) for c, own in held.items() for i in own for j in own if i < j}
    got = pairs.collect()
    assert len(got) == len(want) and {(r.cluster_id, r.file1_index, r.file2_index): r.similarity for r in got} == want
