"""Exact pairs, clusters and means over equal and nearly equal sets, against plain Python."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpuslens.config import DEFAULT
from corpuslens.functions import kernels
from corpuslens.functions import text as T
from corpuslens.operators import blocks, clustering, compare, similarity
from corpuslens.plans.scan import Scan


def made(seed):
    rng = random.Random(seed)
    families = [[f"s{rng.randrange(10**6)}" for _ in range(30)] for _ in range(8)]
    rows = []
    for i in range(110):
        own = list(families[rng.randrange(8)])
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            own[rng.randrange(30)] = f"t{rng.randrange(500)}"
        rng.shuffle(own)
        rows.append((i, list(dict.fromkeys(own)) if i % 20 else []))
    return rows


def similarity_of(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("seed", "threshold", "block"), [(1, 0.7, 256), (2, 0.5, 3)])
def test_exact_clusters(spark, monkeypatch, seed, threshold, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows = made(seed)
    own = {i: set(s) for i, s in rows if s}
    sets = spark.createDataFrame(rows, "file_index long, sh array<string>").repartition(3)
    pairs = {(i, j): similarity_of(own[i], own[j]) for i in own for j in own if i < j and similarity_of(own[i], own[j]) >= threshold}
    assert {(r.i, r.j): r.jaccard for r in similarity.similar_pairs(sets, threshold).collect()} == pairs
    near = {i: {i} | {b if a == i else a for a, b in pairs if i in (a, b)} for i in own}
    want, taken = [], set()
    for i in sorted(own):
        if i not in taken and len(near[i]) > 1:
            want.append(near[i])
            taken |= near[i]
    of = similarity.collapsed(sets)
    members = clustering.members(similarity.class_edges(sets, of, threshold), of)
    got = {}
    for r in members.collect():
        got.setdefault(r.cluster_id, set()).add(r.file_index)
    assert [got[k] for k in sorted(got)] == want and members.count() == sum(map(len, want))
    means = {r.cluster_id: r.mean for r in clustering.pair_means(members, sets, of).collect()}
    for k, m in enumerate(want):
        all_ = [similarity_of(own[a], own[b]) for a in m for b in m if a < b]
        assert means[k] == pytest.approx(sum(all_) / len(all_), abs=1e-12)
    left, right = sets.where("file_index % 3 = 0"), sets.where("file_index % 3 > 0")
    best = {}
    for j in own:
        met = [(similarity_of(own[i], own[j]), -i) for i in own if i % 3 == 0 and j % 3 and similarity_of(own[i], own[j]) >= threshold]
        if met:
            best[j] = (max(met)[0], -max(met)[1])
    assert {r.j: (r.jaccard, r.i) for r in similarity.best_pairs(left, right, threshold).collect()} == best


def test_copies_cost_a_row_each(spark):
    n = 20_000
    text = " ".join(f"w{i}" for i in range(40))
    files = spark.range(n).select(F.col("id").alias("file_index"), F.lit("m").alias("marketplace"), F.lit("p").alias("plugin"), F.lit("x.md").alias("relative_path"), F.when(F.col("id") == 7, text + " and a few words more").otherwise(text).alias("content")).repartition(4)
    scan = Scan(files)
    one = scan.clusters().first()
    assert (one.type, one.size, one.avg_similarity) == ("scaffold", n, 1.0) and scan.edges.count() == 1
    assert compare.best_matches(scan.sets.where("file_index % 2 = 1"), scan.sets.where("file_index % 2 = 0")).where("similar_to = 0").count() == n // 2


def test_scaffolds_are_internal(spark):
    """Copies in several collections are no scaffold."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"m{i % 2}", "p", "x.md", text) for i in range(8)]
    frame = spark.createDataFrame(rows, "file_index long, marketplace string, plugin string, relative_path string, content string")
    assert Scan(frame).clusters().first().type == "cross-marketplace" and Scan(frame, banded=True).clusters().first().type == "cross-marketplace"


def test_numbers_stand_for_shingles(spark):
    """As many numbers as shingles, shared as shingles are; equal sets have equal keys, whatever the texts."""
    texts = ["a b c d", "d c b a", "a  B c, d", "a b c d a b c d", "one", "one two", "two one", "--", "-- -", "é", "", "   ", None, "a b c x y z" * 300, "ÀÉ b c d İ"]
    files = spark.createDataFrame(list(enumerate(texts)), "file_index long, content string")
    config = replace(DEFAULT, min_chars=0)
    got = {r.file_index: (set(r.sh), r.key) for r in kernels.hashed_sets(files, config).collect()}
    want = {r.file_index: set(r.sh) for r in files.where("content is not null").select("file_index", T.shingles(F.col("content")).alias("sh")).collect()}
    assert set(got) == set(want)
    for i in want:
        assert len(got[i][0]) == len(want[i])
        for j in want:
            assert len(got[i][0] & got[j][0]) == len(want[i] & want[j]) and (got[i][1] == got[j][1]) == (want[i] == want[j])
    assert kernels.hashed_sets(files.where("false"), config).count() == 0


def test_prefixes_lose_nothing(spark):
    """Any two sets of the threshold's similarity share a prefix member; a member of all sets comes last."""
    rows = [(i, [7, *(100 * (i // 5) + k for k in range(20)), 5000 + i]) for i in range(60)]
    sets = spark.createDataFrame([*rows, (99, [])], "file_index long, sh array<long>").repartition(3)
    counts = kernels.bucket_counts(sets)
    assert counts.sum() == sum(len(s) for _, s in rows)
    found = {}
    for r in kernels.prefixes(sets, counts, 0.7).collect():
        found.setdefault(r.file_index, set()).add(r.s)
    own = {i: set(s) for i, s in rows}
    assert all(found[i] & found[j] for i in own for j in own if similarity_of(own[i], own[j]) >= 0.7)
    assert not any(7 in s for s in found.values())
