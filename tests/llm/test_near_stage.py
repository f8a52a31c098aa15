"""The pipeline's near-duplicate stage takes SimHash's links and those of an exact similarity together."""

import corpus_pipeline
from corpuslens.llm import simhash
from corpuslens.llm.components import TASKS, connected_components


def test_stage_takes_simhash_links(spark):
    # what is repeated decides a fingerprint, and counts once in a set of shingles
    body = "a b c d e f g " * 300
    near, base, far = (" ".join(f"{x}{i}" for i in range(40)) for x in "uvw")
    docs = [(1, body + near), (2, body + base), (3, far), (4, body + base + " more"), (5, body + base)]
    assert (simhash.fingerprint(docs[0][1].encode()) ^ simhash.fingerprint(docs[1][1].encode())).bit_count() <= simhash.RADIUS
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_dissimilar(docs).collect()} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()} == {1, 3}


def test_rounds_of_a_small_graph_write_few_files(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        roots = connected_components(spark.createDataFrame([(i, i + 1) for i in range(400) if i % 4 < 3], "a long, b long"))
        assert {(r.node, r.root) for r in roots.collect()} == {(i, i - i % 4) for i in range(400) if i % 4}
        assert len(roots.inputFiles()) <= TASKS
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_near_stage_joins_links_once(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(simhash, "connected_components", lambda edges, f=connected_components: runs.append(1) or f(edges))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 3, i % 3 + 60))) for i in range(9)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_unlike(docs).collect()} <= {0, 1, 2}
    assert len(runs) == 3  # two of the exact similarity, and one that joins all links
