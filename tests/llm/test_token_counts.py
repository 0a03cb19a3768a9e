import os

import pytest

from corpusmill.llm import token_counts

ROWS = [(1, "Hello world, this is a test."), (2, None), (3, ""), (4, "été " * 3000), (5, "Hello world, this is a test."), (None, "<|endoftext|>"), (7, "x y z")]


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_table_against_brute_force(spark, file):
    path = f"/opt/tokenizers/{file}"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files")
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, docs int")
    counted = token_counts.count_tokens(docs, path)
    n = [r.n_tokens for r in counted.collect()]
    assert n == token_counts.encoder(path)([t or "" for _, t in ROWS])
    table = token_counts.length_table(counted)
    for r in table.collect():
        assert r.docs == n.count(r.n_tokens)
        assert r.docs_longer == sum(x > r.n_tokens for x in n) and r.tokens_longer == sum(x for x in n if x > r.n_tokens)
        assert r.tokens_at_limit == sum(min(x, r.n_tokens) for x in n)
        assert (r.total_docs, r.total_tokens) == (len(n), sum(n))
    assert {r.n_tokens for r in table.collect()} == set(n)
    got = {r.context: (r.docs_cut, r.tokens_kept) for r in token_counts.tokens_at_limits(table, [0, 5, 2048, 10**6]).collect()}
    assert got == {c: (sum(x > c for x in n), sum(min(x, c) for x in n)) for c in (0, 5, 2048, 10**6)}
    half = token_counts.quantiles(table, [0.5, 1.0]).collect()
    assert {r.share: r.n_tokens for r in half} == {0.5: sorted(n)[3], 1.0: max(n)}


def test_both_files_of_one_vocabulary_agree():
    if not os.path.exists(token_counts.TOKENIZER):
        pytest.skip("no vocabulary files")
    texts = ["It's 12345 o'clock!!  \n\n  naïve café %%%", "abc " * 50, "日本語のテキスト"]
    assert token_counts.encoder(token_counts.TOKENIZER)(texts) == token_counts.encoder("/opt/tokenizers/byte_bpe_50k.json")(texts)


def test_empty(spark):
    assert token_counts.length_table(spark.createDataFrame([], "n_tokens long")).count() == 0
