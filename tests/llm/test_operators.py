"""Each operator against a plain-Python version on whole small tables, and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslens.llm import blocks, embeddings, licenses, mixing, packing, quality, queries, sharding, simhash, substring, tokens, url_filter
from corpuslens.llm.components import connected_components

PASSAGE = " ".join(f"w{i}" for i in range(70))
TEXTS = [
    (1, PASSAGE), (2, "x y " + PASSAGE + "\n\nz"), (3, PASSAGE), (3, PASSAGE), (None, PASSAGE), (None, None), (4, None), (5, ""), (6, " \t\n "),
    (7, "One two"), (8, "one  two"), (9, "été naïve <|endoftext|> 漢字  tab\tend "), (10, "a " * 400), (11, "word " * 3 + PASSAGE[:120]), (12, "\x1cq\x85r  s   t\n \n u"),
    (13, "z " + PASSAGE + " " + " ".join(f"v{i}" for i in range(60))), (14, " ".join(f"v{i}" for i in range(60)) + " end"), (15, "long" + "g" * 20_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en" if i % 3 else None, [None, "", "b", "hot", "hot"][i % 5], i, "x") for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string").repartition(3)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    want = components({x for p in pairs for x in p}, pairs)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in want} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def url_case(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, "allow")))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/71?q#f", "https://a.b.example.com/en/8", "ftp://com/en/", "http://xcom/en/", "http://example.net/de/8", "http://sub.example.net/de/81/", "http://example.net/de/9", "http://a.org?x=/es/", "http://a.org/es/://b.com/en/", "http://com./en/", "http://É.COM/en/x\ny", "http://a.org/es/" + "y" * 9000, "http://example.com/en/71?q#f", "://x.net/de/8#"] * 2
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    out = url_filter.filter_urls(df, "url", url_filter.rules_frame(spark, queries.URL_RULES))
    assert out.columns == ["page_id", "url", "rule", "url_filter"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.select("page_id", "url_filter.*").collect()}
    assert got == {i: url_case(u) for i, u in enumerate(urls)}
    none = url_filter.filter_urls(df, "url", url_filter.rules_frame(spark, []))
    assert none.where("url_filter.verdict = 'allow' and url_filter.rule is null").count() == len(urls)


def repeats(docs):
    split = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return Counter(out)


def test_substring(spark, sf_dir, odd):
    for docs in (documents(spark, sf_dir), odd, odd.where("false")):
        want = repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert rows_of(substring.repeated_passages(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
        left = substring.cut_repeats(docs)
        assert left.columns == docs.columns
        got = Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in left.collect())
        assert got == Counter({k: n for (d, _, _, s), n in want.items() for k in [(d, s)]}) or got == sum((Counter({(d, s): n}) for (d, _, _, s), n in want.items()), Counter())


def test_emptied_automaton_removes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, PASSAGE), (2, "x y " + PASSAGE), (3, "q " + PASSAGE + " r")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.repeated_passages(docs).collect()} == {1: 0, 2: 70, 3: 70}
    shard = substring.Shard()
    for phrase in (PASSAGE.split()[i : i + substring.PHRASE] for i in range(10)):
        shard.add(" ".join(phrase).encode())
    assert shard.hits(("z " + PASSAGE).encode().split()).tolist() == list(range(1, 11))
    assert substring.Shard().hits(PASSAGE.encode().split()).tolist() == []


def test_automaton_over_many_words():
    rnd = random.Random(5)
    words = [f"w{i}".encode() for i in range(3000)]
    texts = [[rnd.choice(words) for _ in range(200)] for _ in range(40)]
    shard, phrases = substring.Shard(), set()
    for text in texts[:30]:
        for i in rnd.sample(range(185), 20):
            phrases.add(tuple(text[i : i + 16]))
            shard.add(b" ".join(text[i : i + 16]))
    assert len(shard.codes) > 1000  # more than one character of each alphabet
    for text in [*texts, texts[0] + [b"unknown"] + texts[1], texts[2][::-1], texts[0][:15], []]:
        assert shard.hits(text).tolist() == [i for i in range(len(text) - 15) if tuple(text[i : i + 16]) in phrases]


def test_substring_over_shards_and_tasks(spark, monkeypatch):
    """Many shards, many tasks a shard, a hot passage, one doc_id with many texts, and repeated rows give the same result."""
    monkeypatch.setattr(substring, "SHARD_PHRASES", 3)
    monkeypatch.setattr(substring, "TASK_WORDS", 200)
    rng = np.random.default_rng(8)
    passages = [" ".join(f"p{x}" for x in rng.integers(0, 900, 75)) for _ in range(6)]
    docs = []
    for i in range(90):
        own = [" ".join(f"o{x}" for x in rng.integers(0, 5000, 20)), passages[0] if i % 2 else passages[rng.integers(1, 6)][: int(rng.integers(150, 400))], f"tail{i}"]
        docs.append((7 if i % 10 == 0 else i, " ".join(own)))
    docs += docs[:8]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows_of(substring.repeated_passages(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == repeats(docs)
    clash = frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("h", "row", "_d", "_h", "touched", "held", "changed", "starts", "copy", "n_chars"))])
    left = substring.cut_repeats(clash)
    assert left.columns == clash.columns and rows_of(left, "doc_id", "h", "copy", "starts") == rows_of(clash, "doc_id", "h", "copy", "starts")


def test_mixing(spark, sf_dir, odd):
    for docs in (documents(spark, sf_dir), odd, odd.where("false")):
        plan = mixing.mixing_plan(docs).collect()
        assert sum(r.n_rows for r in plan) == docs.count()
        by, taken, largest = {}, Counter(), Counter()
        for r in plan:
            by[r.source] = (r.source_size, r.target)
            taken[r.source] += r.size * r.passes * r.n_rows
            largest[r.source] = max(largest[r.source], r.size * r.n_rows)
            assert 0 <= r.passes <= 2
        names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        budget, stopped = 1.5 * sum(s for s, _ in by.values()), set()
        while True:
            rest = budget - sum(2 * by[s][0] for s in stopped)
            target = {s: 2 * by[s][0] if s in stopped else rest * weight[s] / sum(weight[x] for x in names if x not in stopped) for s in names}
            more = {s for s in names if s not in stopped and target[s] > 2 * by[s][0]}
            if not more:
                break
            stopped |= more
        for s in names:
            assert by[s][1] == pytest.approx(target[s])
            assert abs(taken[s] - target[s]) <= 2 * max(largest.values())
        again = rows_of(mixing.mixing_plan(docs.repartition(5)), "doc_id", "text_key", "passes")
        assert again == Counter((r.doc_id, r.text_key, r.passes) for r in plan)
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns and mixed.count() == sum(r.n_rows * r.passes for r in plan)


def test_mixing_takes_repeated_rows_one_by_one(spark):
    rows = [(5, "a", "one two three four five", i % 3) for i in range(1000)] + [(i, "b", "w " * 9, 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, extra int")
    plan = mixing.mixing_plan(docs).collect()
    by = {s: (sum(r.size * r.passes * r.n_rows for r in plan if r.source == s), next(r.target for r in plan if r.source == s)) for s in "ab"}
    assert all(abs(taken - target) <= 2 * 9 for taken, target in by.values())
    mixed = mixing.mix(docs)
    got = Counter(r.source for r in mixed.collect())
    assert {s: got[s] * n for s, n in (("a", 5), ("b", 9))} == {s: taken for s, (taken, _) in by.items()}
    assert rows_of(mixed, "doc_id", "extra") == rows_of(mixing.mix(docs.repartition(7)), "doc_id", "extra")


CLASH = ["row", "r", "h", "n", "c", "d", "s", "t", "x", "_d", "_h", "_n", "_key", "_kept", "_one", "_new", "_p", "_best", "host", "path", "start", "at", "key", "node", "kept", "one", "two", "pid", "pos", "ends", "slice", "root", "size", "copy", "nth", "bits", "shard"]


@pytest.mark.parametrize("apply", [mixing.mix, substring.cut_repeats, simhash.keep_one, simhash.keep_dissimilar, quality.keep_good, lambda d: sharding.shard(d.drop("shard"), 3), lambda d: url_filter.filter_urls(d, "text", url_filter.rules_frame(d.sparkSession, queries.URL_RULES))])
def test_clashing_columns_nulls_and_empty_tables(spark, odd, apply):
    docs = odd.drop("shard").select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    docs = docs.unionByName(spark.createDataFrame([(77 + i, "word list number with some more words in it and then again some, until there are over twenty words in all of this text here", "en", "b", 1) for i in (0, 0, 1)], "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH]))
    out = apply(docs)
    for c in CLASH[:-1]:
        assert {r[0] for r in out.select(f"`{c}`").distinct().collect()} <= {f"own {c}"}, c
    assert set(docs.columns) - {"shard"} <= set(out.columns)
    assert apply(docs.where("false")).count() == 0


def test_unlike_texts_of_one_id_stay(spark):
    words = [" ".join(f"{x}{i}" for i in range(40)) for x in "abc"]
    docs = spark.createDataFrame([(3, words[0], 1), (3, words[1], 2), (3, words[1], 2), (3, words[1], 5), (9, words[0], 3), (1, words[2], 4)], "doc_id long, text string, more int")
    for keep in (simhash.keep_one, simhash.keep_dissimilar):
        assert rows_of(keep(docs), "doc_id", "text") == Counter([(3, words[0]), (3, words[1]), (1, words[2])])


def test_url_rules_of_many_shapes(spark):
    rules = [(".".join("abcdefg"[: i % 7 + 1]), "/" + "y" * i, "block" if i % 2 else "allow") for i in range(900)]
    urls = [f"http://x.{h}{p}{'y' * (i % 3)}" for i, (h, p, _) in enumerate(rules)][::7]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, "url", url_filter.rules_frame(spark, rules)).select("page_id", "url_filter.*").collect()}
    for i, url in enumerate(urls):
        host, _, path = url[7:].partition("/")
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == max(fits, key=lambda x: len(x[0]))


def plain_fingerprint(text):
    w = b"".join(bytes([c + 32]) if 65 <= c <= 90 else bytes([c]) for c in (text or "").encode()).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf_dir, odd):
    for docs in (documents(spark, sf_dir), odd, odd.where("false")):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        fps = sorted({f for _, f in rows})
        of = components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3])
        least = {}
        for d, f in rows:
            if d is not None:
                least[of[f]] = min(least.get(of[f], d), d)
        assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == Counter((d, f"{f:016x}", least.get(of[f])) for d, f in rows)
        kept = rows_of(simhash.keep_one(docs), "doc_id")
        assert kept == Counter([(x,) for x in least.values()] + [(None,) for d, _ in rows if d is None])


def test_covering(spark):
    rng = np.random.default_rng(1)
    masks = simhash.covering_masks()
    assert len(masks) == 15
    for _ in range(3000):
        d = sum(1 << int(i) for i in rng.choice(64, 3, replace=False))
        assert any(not d & m for m in masks)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.choice(60, 2, replace=False)) for b in base[:2] for _ in range(60)} | set(base))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3])
    for large in (4096, 3):
        got = components(fps, [(r.a, r.b) for r in simhash.covering_edges(frame, large=large).collect()])
        assert got == want


def test_sharding(spark, sf_dir, odd):
    for docs, n in ((documents(spark, sf_dir).repartition(7), 40), (odd, 4), (odd.where("false"), 4)):
        out = sharding.shard(docs.select("doc_id", "source"), n)
        rows = out.collect()
        sizes = Counter(r.shard for r in rows)
        counts = [sizes[i] for i in range(n)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == docs.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert Counter((r.doc_id, r.source) for r in rows) == rows_of(docs, "doc_id", "source")


def test_hypergeometric_law(spark):
    sql = sharding.hypergeometric("60L", "25L", "20L", "((id + 0.5D) / 20000)")
    rows = spark.range(20000).selectExpr(f"{sql} as k").groupBy("k").count().collect()
    from math import comb

    for r in rows:
        assert abs(r["count"] / 20000 - comb(25, r.k) * comb(35, 20 - r.k) / comb(60, 20)) < 1e-3
    parts = spark.createDataFrame([(i, 10 + i) for i in range(600)], "pid long, n long")
    matrix = sharding.communication_matrix(parts, 7, 1).collect()
    assert all(sum(r.counts) == 10 + r.pid and min(r.counts) >= 0 for r in matrix) and len(matrix) == 600
    columns = np.array([r.counts for r in matrix]).sum(0)
    assert columns.max() - columns.min() <= 1


def plain_ids(text):
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_packing(spark, sf_dir, odd):
    for docs in (documents(spark, sf_dir), odd):
        rows, model = packing.pack(docs).collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = [*model.encode(r.text or "", add_special_tokens=False).ids, 0]
            for s in range(0, len(ids), 1024):
                want[(r.doc_id, s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()), len(ids))] += 1
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
        by = defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for own in by.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
        total = sum(r.length for r in rows)
        assert len(by) * 1024 <= total * 1.06 + 1024 * 2
    assert packing.pack(odd.where("false")).count() == 0


def test_token_counts(spark, odd, sf_dir):
    for docs in (odd, documents(spark, sf_dir)):
        model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            if not r.text:
                continue
            enc = model.encode(r.text, add_special_tokens=False)
            for i, (s, e) in enumerate(tokens.lines_of(r.text)):
                begin = sum(s <= a < e for a, _ in enc.offsets)
                want[(r.doc_id, i, s, e, begin, len(enc.ids))] += 1
        got = tokens.section_tokens(docs)
        same = rows_of(got, "doc_id", "section", "start", "end", "tokens", "doc_tokens")
        assert sum((same - want).values()) <= 0.001 * sum(want.values())  # offsets of split characters round differently
        assert got.where("crossing > tokens or crossing < 0").count() == 0


def licence(family, text):
    return family + "-3.0" * (family == "gpl" and "version 3" in text)


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
BSD = "Copyright (c) 2024, A. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n 1. Redistributions of source code must retain the above copyright notice.\n\n"
BSD_2, BSD_3 = " 2. Redistributions in binary form must reproduce the above copyright notice.\n", "\n 3. Neither the name of the copyright holder nor\n the names of its contributors may be used.\n"


def test_licences_of_one_family(spark):
    """None of these texts is in training: what follows a notice tells the licence."""
    cases = [
        (GPL.format("General", 2), {"gpl-2.0-or-later"}), (GPL.format("General", 3), {"gpl-3.0-or-later"}), (GPL.format("Lesser General", "2.1"), {"lgpl-2.1-or-later"}),
        (GPL.format("Lesser General", 3), {"lgpl-3.0-or-later"}), (GPL.format("Affero General", 3), {"agpl-3.0-or-later"}),
        (f"{'word ' * 31}{GPL.format('General', 2)}", {"gpl-2.0-or-later"}), (f"{'word ' * 17}\n# {GPL.format('General', 2)}".replace(" the ", " the\n# "), {"gpl-2.0-or-later"}),
        (GPL.split(" as published")[0].format("General") + ".", {"gpl"}), ("This work is licensed under the GNU General Public License, version 2.", {"gpl-2.0"}),
        (BSD, {"bsd"}), (BSD + BSD_2, {"bsd-2-clause"}), (BSD + BSD_2 + BSD_3, {"bsd-3-clause"}), ("Copyright (c) 2024, A.\nAll rights reserved.", {"proprietary"}),
        ("Released under the MIT License." + "\nline" * 60 + "\nAll rights reserved.", {"mit", "proprietary"}), (BSD + "\nline" * 60 + "\n" + GPL.format("General", 2), {"bsd", "gpl-2.0-or-later"}),
    ]
    got = {}
    for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    assert got == {i: f for i, (_, f) in enumerate(cases)}


def test_licenses(spark):
    notices = [(licence(f, t), t) for f, texts in licenses.NOTICES.items() for t in texts]
    prose = ["the quick brown fox under the terms of the hill", "all rights were lost", "version 2.0 of the plan", None, "", "MIT is a university."]
    docs = [(i, f"Some words here.\n{t}\nMore of the text.") for i, (_, t) in enumerate(notices)] + [(100 + i, t) for i, t in enumerate(prose)]
    got = {(r.doc_id, r.paragraph): r.family for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(i, 1): f for i, (f, _) in enumerate(notices)}


def test_license_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    want = {(r.doc_id, r.paragraph) for r in exact.collect() if r.line in {t for x in licenses.NOTICES.values() for t in x}}
    got = {(r.doc_id, r.paragraph) for r in licenses.scan(docs).collect()}
    assert want and len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 64))
    near = [b + rng.normal(size=64) * s for b in base[:20] for s in (0.1, 0.3, 0.45)]
    vectors = [*base, *near, *base[:5], *base[:5], *(base[7] + rng.normal(size=64) * 0.1 for _ in range(150))]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, [float("nan")] * 64, 0), (n + 3, [None] * 64, 0), (n + 4, [], 0), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    x = np.array([r[1] for r in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9) & ~np.eye(n, dtype=bool)
    for block in (2048, 16):
        embeddings.BLOCK = block
        got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
        links = np.array([got[i].n_links for i in range(n)])
        assert (links <= true.sum(1)).all() and links.sum() >= 0.95 * true.sum()
        for i in range(n):
            assert got[got[i].component_id].component_id == got[i].component_id <= i and got[i].kept == (got[i].component_id == i)
        assert all((got[n + i].n_links, got[n + i].component_id, got[n + i].kept) == (0, n + i, True) for i in range(5))
        assert got[n + 6].component_id == n + 5
    embeddings.BLOCK = 2048
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_lists_of_any_length_are_counted():
    """Rare numbers and numbers that most rows hold, empty rows, no rows: the same counts as sets give."""
    rng = random.Random(5)
    for _ in range(200):
        sides = [[set(rng.sample(range(60), rng.randrange(40))) if rng.random() < 0.5 else {rng.randrange(500) for _ in range(rng.randrange(20))} for _ in range(rng.randrange(30))] for _ in "ab"]
        flat = [blocks.sorted_lists(*(np.array([x[k] for x in ((v, i) for i, s in enumerate(side) for v in s)], np.int64) for k in (0, 1))) for side in sides]
        got = blocks.counted(*flat[0], len(sides[0]), *flat[1], len(sides[1]))
        assert got.tolist() == [[len(a & b) for b in sides[1]] for a in sides[0]]


def test_shared_pivots_are_counted():
    rng = np.random.default_rng(6)
    a, b = (np.array([rng.choice(40, 12, replace=False) for _ in range(n)]) for n in (30, 50))
    for at_once in (7, 4_000_000):
        blocks.AT_ONCE = at_once
        assert (embeddings.shared(a, b) == [[len(set(x) & set(y)) for y in b.tolist()] for x in a.tolist()]).all()


@pytest.mark.parametrize(("n", "d"), [(280, 64), (30_000, 16), (51_282, 64), (51_282, 768), (1_000_000, 64), (20_000_000, 64)])
def test_embedding_recall_by_shape(n, d):
    """Pairs at a cosine of exactly 0.9 that the index of n vectors finds; one pair in ten thousand or fewer by chance."""
    pivots, near, first, enough = embeddings.index_shape(n)
    rng, g = np.random.default_rng(n + d), embeddings.directions(pivots, d, 3)
    x, r = rng.normal(size=(2, 600, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r -= (r * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * r / np.linalg.norm(r, axis=1, keepdims=True)
    a, b = (embeddings.permutations(v, g, near) for v in (x, y))
    found = [len(set(p) & set(q)) >= enough and bool(set(p[:first]) & set(q[:first])) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.mean(found) >= 0.93
    if n > 50_000:
        chance = embeddings.shared(a, a) >= enough
        assert (chance.sum() - len(a)) / len(a) ** 2 < 1e-4


@pytest.mark.parametrize(("c", "most"), [(0.0, 0.05), (0.2, 0.06), (0.5, 0.05), (0.8, 0.2)])
def test_embedding_recall_off_centre(c, most):
    """Vectors with a median cosine of c: pairs at 0.9, away in any direction or along their kind's, that an index of 50,000 finds,
    and pairs that share a list as a share of all pairs."""
    d, n = 384, 700
    rng, mu = np.random.default_rng(8), np.zeros(384)
    mu[0] = c**0.5
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    draw = lambda k: unit(mu + (1 - c) ** 0.5 * unit(rng.normal(size=(k, d))))
    off, left = embeddings.off_mean(draw(20_000).mean(0), 0.9)
    pivots, near, first, enough = embeddings.index_shape(50_000, left)
    points = embeddings.apart(embeddings.taken_off(draw(embeddings.SAMPLE), off))[:pivots]
    g = np.concatenate([points, embeddings.directions(pivots - len(points), d, 3)])
    x, r, away = draw(n), rng.normal(size=(n, d)), rng.normal(size=(n, d))
    r -= (r * x).sum(1, keepdims=True) * x
    own = unit(x - mu)
    away[:, 0] = 0
    away -= (away * own).sum(1, keepdims=True) * own
    rho = (0.9 - c) / (1 - c)
    a = embeddings.permutations(embeddings.taken_off(x, off), g, near)
    for y in (0.9 * x + 0.19**0.5 * unit(r), unit(mu + (1 - c) ** 0.5 * (rho * own + (1 - rho * rho) ** 0.5 * unit(away)))):
        b = embeddings.permutations(embeddings.taken_off(y, off), g, near)
        found = [len(set(p) & set(q)) >= enough and bool(set(p[:first]) & set(q[:first])) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
        assert np.mean(found) >= 0.9
    assert (np.bincount(a[:, :first].ravel()).astype(float) ** 2).sum() / n**2 < most


@pytest.mark.parametrize("c", [0.6, 0.97])
def test_embeddings_off_centre_table(spark, c):
    """A common direction in all vectors, planted near copies, vectors of other lengths, one vector that is the mean: by brute force."""
    rng, mu = np.random.default_rng(9), np.zeros(64)
    mu[0] = c**0.5
    x = rng.normal(size=(1200, 64))
    x = mu + (1 - c) ** 0.5 * x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([x, x[:200] + rng.normal(size=(200, 64)) * 0.03, mu[None], -mu[None]]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000 + i, [1.0] * (i % 20 + 1)) for i in range(40)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()}
    links = np.array([got[i] for i in range(len(x))])
    assert (links <= true).all() and links.sum() >= 0.9 * true.sum() and len(got) == len(rows)
    assert all(got[5000 + i] == 1 for i in range(40))


def test_embeddings_of_a_planted_table(spark):
    """Large groups of near copies and of copies among unlike vectors, against brute force, in few and in many blocks."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(30, 64))
    vectors = np.concatenate([rng.normal(size=(3000, 64)), *(c + rng.normal(size=(n, 64)) * 0.3 for c, n in zip(centres, [500] + [20] * 29, strict=True)), np.repeat(centres[:1], 400, axis=0)])
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate(vectors.astype(np.float32))]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9).sum(1) - 1
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node long").repartition(5)
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    links = np.array([got[i].n_links for i in range(len(rows))])
    assert (links <= true).all() and links.sum() >= 0.95 * true.sum() and len(got) == len(rows)


def test_quality_counts(spark, sf_dir, odd):
    for docs in (documents(spark, sf_dir), odd, odd.where("false")):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            t = r.text or ""
            w = [x.decode() for x in t.encode().split()]
            runs = defaultdict(list)
            for i in range(len(w) - 7):
                runs[tuple(w[i : i + 8])].append(i)
            again = {j for s in runs.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
            lines = [x for x in t.split("\n") if x.encode().split()]
            failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
            want[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed)] += 1
        got = quality.judge(docs)
        assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
        assert got.where("kept and base_failed").count() == 0
        kept = quality.keep_good(docs)
        assert kept.columns == docs.columns and rows_of(kept, "doc_id") == rows_of(got.where("kept"), "doc_id")


def test_kneser_ney_sums_to_one(spark, sf_dir):
    model = quality.Model(documents(spark, sf_dir).limit(40))
    smooth = model.smoothing.value
    keys = np.concatenate([quality.unpacked_sorted(r.keys) for r in model.table.collect()])
    a, b = quality.parts_of(keys)
    assert len(np.unique(keys)) == len(keys) == model.costs().count() > 1000
    costs = {r.pair: r.cost for r in model.costs().collect()}
    share = np.exp2(-np.array([costs[k] for k in keys.view(np.int64).tolist()]) / 1e6)
    for unit in np.unique(a)[::50].tolist():
        own = a == unit
        unseen = smooth.lower.sum() - smooth.lower[b[own]].sum()
        assert share[own].sum() + smooth.freed[unit] / smooth.total[unit] * unseen == pytest.approx(1, abs=1e-4)


def test_quality_blocks_and_hot_pairs_do_not_change_bits(spark, sf_dir, monkeypatch):
    docs = documents(spark, sf_dir).limit(60).unionByName(spark.createDataFrame([(-1, "漢字かな " * 700 + "end.\n" * 900 + "x" * 9000, "ja", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    want = rows_of(quality.judge(docs), "doc_id", "bits")
    assert all(b is not None for (_, b) in want)
    for name, value in (("HOT", 1), ("HOT", 300), ("BLOCK", 1000), ("HELD", 500), ("SHARD", 2000)):
        monkeypatch.setattr(quality, name, value)
    model = quality.Model(docs)
    assert model.shards > 1 and 0 < len(model.hot.value[0]) <= 300 < model.costs().count()
    # The run of 9000 letters is cut at other places; all other texts have the same bits.
    assert rows_of(quality.judge(docs).where("doc_id >= 0"), "doc_id", "bits") == Counter({k: n for k, n in want.items() if k[0] >= 0})


def test_quality_bands_keep_good_and_reject_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = quality.judge(docs).join(labels, "doc_id").where("not base_failed")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("kept").count() >= 0.995 * good.count()
    assert bad.where("not kept").count() > 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = documents(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == before.columns and 0 < docs.count() <= 2 * before.count()
    packed = corpus_pipeline.run(spark, sf_dir)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter({r.doc_id: 0 for r in docs.collect()})
    for r in docs.collect():
        ids[r.doc_id] += len(model.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed.collect():
        got[r.doc_id] += r.length
    assert got == ids


def test_license_key_words_lose_nothing():
    finder = licenses.Finder()
    for n in finder.notices:
        keys = set(finder.keys)
        left = [g for g in n.grams if not keys & set(g.split())]
        assert len(left) < licenses.CONFIRM * len(n.grams) or keys & set(n.name)


def test_licenses_by_brute_force(spark):
    """Notices in forms that training has not: edited, wrapped, in comments, beside others; and licences left out of training."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n).tolist())
    docs, want = [], set()
    for f, texts in licenses.NOTICES.items():
        for t in texts:
            docs.append((len(docs), f"{prose(400)}\n{prose(5)}. {t} {prose(7)}\n\n{prose(30)}"))
            want.add((len(docs) - 1, 1, licence(f, t)))
            if len(t.split()) > 12:
                edited = t.split()
                edited[1] = "edited"
                docs.append((len(docs), f"/* {prose(200)}\n *\n * " + "\n * ".join(" ".join(edited[i : i + 6]) for i in range(0, len(edited), 6))))
                want.add((len(docs) - 1, 2, f))
    both = f"Released under the MIT License. {prose(100)}\nLicensed under CC BY 4.0."
    docs.append((900, both))
    want |= {(900, 0, "mit"), (900, 1, "cc-by-4.0")}
    docs += [(901, "We do not say all rights reserved. here"), (902, "This work is licensed under the GNU Library General Public License, version 3."), (903, "the license of the software and the general public"), (904, None), (905, "Licensed under the Creative Commons licence")]
    docs += [(None, "Copyright 2024 A. All rights reserved."), (None, "Copyright 2024 A. All rights reserved.")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, words string")
    got = Counter((r.doc_id, r.paragraph, r.family) for r in licenses.scan(frame).collect())
    assert got == Counter(want) + Counter({(None, 0, "proprietary"): 2})
    without = {f: t for f, t in licenses.NOTICES.items() if f not in ("lgpl", "agpl", "cc-by-sa-4.0")}
    left_out = spark.createDataFrame([(i, t) for i, t in enumerate(x for f in ("lgpl", "agpl", "cc-by-sa-4.0") for x in licenses.NOTICES[f])], "doc_id long, text string")
    assert licenses.scan(left_out, families=without).collect() == []
    assert licenses.scan(frame.where("false")).count() == 0


def test_quality_rejects_junk_and_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = quality.judge(docs).where("not base_failed").join(labels, "doc_id", "left").cache()
    kept = {r.quality: (r.n, r.kept) for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.count(F.when(F.col("kept"), 1)).alias("kept")).collect()}
    assert kept[1][1] >= 0.995 * kept[1][0]
    assert kept[0][1] <= 0.05 * kept[0][0]
    symbols = judged.where("n_symbols > 0.05 * word_chars")
    assert symbols.where("kept").count() <= 0.03 * symbols.count()


def test_quality_model_grows_and_is_modified_kneser_ney(spark):
    sizes = []
    for sf in ("0.001", "0.01"):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        sizes.append(quality.pair_costs(docs).count())
    assert sizes[1] > 3 * sizes[0]
    texts = ["the cat saw the dog. the end", "the cat saw a dog", "a cat | a dog", "the cat saw the dog. the end"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    pairs = Counter(p for t in texts for w in [["\n", *t.replace(".", " .").split()]] for p in zip(w, w[1:], strict=False))
    loss, kinds = quality._discounts(np.array(list(pairs.values()))), Counter(b for _, b in pairs)
    low = quality._discounts(np.array(list(kinds.values())))
    rest = sum(low[min(k, 3)] for k in kinds.values())
    lower = {b: (k - low[min(k, 3)] + rest / len(kinds)) / len(pairs) for b, k in kinds.items()}
    want = []
    for (a, b), n in pairs.items():
        own = [m for (c, _), m in pairs.items() if c == a]
        want.append(-np.log2((n - loss[min(n, 3)] + sum(loss[min(m, 3)] for m in own) * lower[b]) / sum(own)))
    assert np.allclose(sorted(r.cost / 1e6 for r in quality.pair_costs(docs).collect()), sorted(want), atol=1e-5)


def test_pipeline_drops_documents_of_similarity_eight_tenths(spark, sf_dir, odd):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    edited = []
    for i in range(60):
        words = [f"t{x}" for x in rng.integers(0, 5000, 120)]
        edited.append((2 * i, " ".join(words)))
        for at in rng.choice(120, 1 + i % 5, replace=False):
            words[at] = "changed"
        edited.append((2 * i + 1, " ".join(words)))
    edited = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in edited], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (documents(spark, sf_dir), odd.where("doc_id is null or doc_id != 3"), odd.where("false"), edited):
        sets = {}
        for r in docs.select("doc_id", "text").collect():
            w = (r.text or "").encode().lower().split()
            sets.setdefault(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))), []).append(r.doc_id)
        nodes = list(sets)
        at, near = defaultdict(list), Counter()
        for i, s in enumerate(nodes):
            for x in s:
                near.update((j, i) for j in at[x])
                at[x].append(i)
        of = components(range(len(nodes)), [(a, b) for (a, b), n in near.items() if n >= 0.8 * (len(nodes[a]) + len(nodes[b]) - n)])
        least = {}
        for i, s in enumerate(nodes):
            for d in sets[s]:
                if d is not None:
                    least[of[i]] = min(least.get(of[i], d), d)
        kept = rows_of(corpus_pipeline.simhash_dedup(spark, docs, sf_dir), "doc_id")
        assert kept == Counter([(x,) for x in least.values()] + [(None,) for s in sets.values() for d in s if d is None])


def test_loose_groups_are_compared_in_blocks(spark, monkeypatch):
    """Copies with edits of their own, alike to some of the others only, over few and many blocks."""
    rng = np.random.default_rng(14)
    base, texts = [f"b{x}" for x in rng.integers(0, 9000, 160)], []
    for i in range(150):
        words = list(base)
        for at in rng.choice(160, int(rng.integers(1, 9)), replace=False):
            words[at] = f"e{i}x{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(i, j) for i in range(150) for j in range(i + 1, 150) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    of = components(range(150), near)
    for block in (2048, 20):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert rows_of(simhash.keep_dissimilar(docs), "doc_id") == Counter((i,) for i in set(of.values()))
    assert 1 < len(set(of.values())) < 140


def test_licenses_wrapped_over_lines(spark):
    import textwrap

    notices = [(f, t) for f, texts in licenses.NOTICES.items() for t in texts if len(t.split()) > 10]
    docs, want = [], set()
    for width in (40, 80):
        for mark in ("", "# ", " * "):
            for f, t in notices:
                lines = textwrap.wrap(t, width)
                if max(len(x.split()) for x in lines) < 0.6 * len(t.split()):
                    want.add((len(docs), 2, licence(f, t)))
                    docs.append((len(docs), "\n".join(mark + x for x in ["Some words here", "and one more line.", *lines, "More of the text."])))
    docs += [(900, "under the terms of\nthe hill\n\nthe GNU General\n\nPublic License"), (901, "Permission is hereby granted, free of charge,\n\nto any person obtaining a copy of this software and associated documentation files"), (902, None)]
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(want) > 10 and got == want


def test_quality_bits_do_not_depend_on_hot_pairs(spark, monkeypatch):
    english, french = "the cat and the dog saw that it was there. ", "le chat et le chien de la rue sont dans une maison. "
    texts = [("en", english * 3)] * 3 + [("fr", french * 3)] * 3 + [("en", english * 2 + french * 2), ("de", "der hund und die katze. " * 4)]
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(texts)], "doc_id long, lang string, text string")
    want = rows_of(quality.judge(docs), "doc_id", "bits")
    monkeypatch.setattr(quality, "HOT", 1)
    assert rows_of(quality.judge(docs), "doc_id", "bits") == want


def test_license_sample_counts_different_windows(spark):
    lines = [f"the license of number {i} is subject to the terms" + " of the general public" * (i % 7) for i in range(100)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines * 30)], "doc_id long, text string")
    finder = licenses.Finder()
    whole, few = (licenses.training_rows(docs, finder, n).count() for n in (60, 0))
    assert 1 < whole - few <= 60
    rows = [tuple(sorted(r.grams)) for r in finder.with_grams(finder.windows(docs)).collect()]
    assert len(rows) == 3000 and len(set(rows)) == whole - few
