"""The pipeline and op6 on empty tables and rows of nulls, and op6's boundary rule by brute force."""

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from corpuslens.llm import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, None, "b", None), (3, " \n ", "en", None, 3)]])
def test_pipeline_on_awkward_tables(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # rows without words are rejected by the rules


def test_crossing_tokens_by_brute_force(spark):
    """Sections that cut words: a token counts for the section of its first byte, and as crossing if it ends beyond it."""
    texts = [(i, ("naïve interoperability été 漢字かな 12345 internationalization " * (i + 1)) + "end") for i in range(6)]
    width = 7
    cut = lambda text: [(at, min(at + width, len(text))) for at in range(0, len(text), width)]
    model, many = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    want = {}
    for key, text in texts:
        raw, lengths = text.encode(), []
        for i in model.encode(text, add_special_tokens=False).ids:
            lengths.append(sum(1 for _ in model.id_to_token(i)))  # a visible character stands for a byte
        assert sum(lengths) == len(raw)
        edges = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in cut(text)]
        counts = [[0, 0] for _ in edges]
        at = 0
        for n in lengths:
            k = next(k for k, (a, b) in enumerate(edges) if a <= at < b)
            counts[k][0] += 1
            counts[k][1] += at + n > edges[k][1]
            at += n
        want |= {(key, k): tuple(c) for k, c in enumerate(counts)}
        many += sum(c[1] for c in counts)
    assert many > 100
    got = tokens.section_tokens(spark.createDataFrame(texts, "doc_id long, text string"), sections=cut)
    assert {(r.doc_id, r.section): (r.tokens, r.crossing) for r in got.collect()} == want
    assert tokens.section_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
