"""Exact pairs by packed members, against plain Python: members that many sets have, several blocks, and no set written."""

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import kernels
from corpuslens.operators import clustering, packed, similarity
from corpuslens.plans.scan import Scan
from tests.test_exact import made, similarity_of


@pytest.mark.parametrize(("heavy", "block"), [(512, 2048), (3, 4)])
def test_heavy_members(spark, monkeypatch, heavy, block):
    monkeypatch.setattr(packed, "HEAVY", heavy)
    monkeypatch.setattr(packed, "BLOCK", block)
    rows = made(5)
    own = {i: set(s) for i, s in rows if s}
    sets = spark.createDataFrame(rows, "file_index long, sh array<string>").repartition(3)
    pairs = {(i, j): similarity_of(own[i], own[j]) for i in own for j in own if i < j and similarity_of(own[i], own[j]) >= 0.7}
    got = similarity.similar_pairs(sets, 0.7).collect()
    assert {(r.i, r.j): r.jaccard for r in got} == pairs and len(got) == len(pairs)
    assert similarity.count_pairs(sets, 0.7) == len(pairs)
    best = {}
    for (i, j), s in pairs.items():
        if i % 2 != j % 2:
            a, b = (i, j) if i % 2 else (j, i)
            best[b] = max(best.get(b, (0, 0)), (s, -a))
    two = similarity.best_pairs(sets.where("file_index % 2 = 1"), sets.where("file_index % 2 = 0"), 0.7)
    assert {r.j: (r.jaccard, -r.i) for r in two.collect()} == best


def test_sets_are_not_written(spark):
    """Shingle sets take twice the texts' room; a scan works them out where it reads them."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat(F.lit("w"), k + F.col("id") % 3 * 100)), " ")
    files = spark.range(9).select(F.col("id").alias("file_index"), F.lit("m").alias("marketplace"), F.lit("p").alias("plugin"), F.lit("x.md").alias("relative_path"), text.alias("content"))
    scan = Scan(files)
    assert "MapInArrow" in scan.sets._jdf.queryExecution().optimizedPlan().toString()
    pairs = clustering.member_pairs(scan.members, scan.sets, scan.of).collect()
    assert len(pairs) == 9 and all(r.similarity == 1.0 and r.file1_index % 3 == r.file2_index % 3 for r in pairs)


def test_clusters_write_no_row_for_a_link(spark, monkeypatch):
    """A group of near copies is linked each with each; clusters take the links as lists, a row for a set and part."""
    rows = [(k, [f"w{x}" for x in range(40)] + [f"own{k}"]) for k in range(30)] + [(k, [f"v{k}"]) for k in (50, 51)] + [(60, ["v50"])]
    sets = spark.createDataFrame(rows, "file_index long, sh array<string>").repartition(3)
    of = similarity.collapsed(sets)
    links = similarity.class_links(sets, of, 0.7)
    got = {r.a: sorted(r.near) for r in links.collect()}
    assert links.count() == 30 and got == {a: [b for b in range(30) if b != a] for a in range(30)}
    monkeypatch.setattr(packed, "PART", 3)
    apart = clustering.linked(similarity.class_edges(sets, of, 0.7))
    assert apart.count() == 30 * 4 and {(r.a, b) for r in apart.collect() for b in r.near} == {(a, b) for a in got for b in got[a]}
    for found in (clustering.linked_members(links, of), clustering.linked_members(apart, of)):
        assert sorted((r.cluster_id, r.file_index) for r in found.collect()) == [(0, k) for k in range(30)] + [(1, 50), (1, 60)]


def test_sets_and_counters_take_one_pass(spark, monkeypatch):
    """Files by equal sets and the counters of members come of the same reading of the texts."""
    rows = made(7)
    sets = similarity._hashed(spark.createDataFrame(rows, "file_index long, sh array<string>").repartition(3))
    want = kernels.bucket_counts(sets)
    monkeypatch.setattr(kernels, "bucket_counts", None)
    of, counts = similarity.counted(sets)
    assert (counts == want).all() and counts.sum() == sum(len(set(s)) for _, s in rows if s)
    assert of.count() == sum(bool(s) for _, s in rows)
    similarity.similar_pairs(sets, 0.7)


@pytest.mark.parametrize("same", [True, False])
def test_a_group_is_sent_once(spark, same):
    """Each set of a group of near copies goes to one cell with all of its pairs; a pair between groups has a cell too."""
    left, right = (range(0, 12), range(0, 12)) if same else (range(0, 6), range(3, 12))
    inside = [(g * 100 + i, g * 100 + j) for g in range(40) for i in left for j in right if i < j or not same]
    found = spark.createDataFrame(inside, "i long, j long")
    placed = packed._placed(found, same, 64, 8)
    cells = packed._cells(placed, same)
    assert sorted((r.i, r.j) for r in placed.collect()) == sorted(inside)
    assert cells.count() == 40 * (12 if same else 6 + 9) and cells.select("side", "id").distinct().count() == cells.count()
    chain = spark.createDataFrame([(k, k + 1) if same else ((k + 1) // 2, k // 2) for k in range(200)], "i long, j long")
    placed = packed._placed(chain, same, 64, 8)
    assert placed.count() == 200 and {r.key for r in placed.select("key").distinct().collect()} == {-1, -2}
    sets = packed._cells(placed, same)
    at = ["key", "one", "two"]
    for c, role in (("i", 0), ("j", 1)):
        there = sets.where(F.col("role").isin(role, 2)).select(*at, F.col("id").alias(c))
        assert placed.join(there, [*at, c]).count() == 200


def test_wanted_texts_alone_are_hashed(spark):
    """Sets that are read again are made from the wanted texts, in the task that uses them."""
    files = spark.range(9).select(F.col("id").alias("file_index"), F.concat(F.lit("one two three four "), F.col("id"), F.repeat(F.lit(" x"), 60)).alias("content"))
    sets = similarity.with_shingles(files)
    some = kernels.only(sets, files.where("file_index in (2, 5)").select("file_index"))
    assert some._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = {r.file_index: list(r.sh) for r in sets.collect() if r.file_index in (2, 5)}
    assert {r.file_index: list(r.sh) for r in some.collect()} == want and len(want) == 2


def test_pairs_that_are_read_once_are_not_written(spark):
    """Pairs of clusters are the largest rows there are; where one query reads them, no checkpoint holds them."""
    files = spark.range(6).select(F.col("id").alias("file_index"), F.lit("m").alias("marketplace"), F.lit("p").alias("plugin"), F.lit("x.md").alias("relative_path"), F.repeat(F.lit("same words here "), 10).alias("content"))
    pairs = Scan(files).cluster_pairs()
    assert "Join" in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.file1_index, r.file2_index, r.similarity) for r in pairs.collect()) == [(i, j, 1.0) for i in range(6) for j in range(i + 1, 6)]
