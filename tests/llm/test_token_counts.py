from tokenizers import Tokenizer

from textmill.llm import token_counts as C
from textmill.llm.encoding import vocabulary

TOKENIZER = Tokenizer.from_file(vocabulary())


def check(df, docs):
    n = sorted(len(TOKENIZER.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs)
    rows = df.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(n))
    for r in rows:
        x = r["n_tokens"]
        assert r["n_docs"] == n.count(x) and r["docs_ge"] == sum(v >= x for v in n) and r["tokens_ge"] == sum(v for v in n if v >= x)
        assert r["truncated_tokens"] == sum(min(v, x) for v in n) and r["docs_le"] == sum(v <= x for v in n) and r["quantile"] == r["docs_le"] / len(n)
        assert (r["total_docs"], r["total_tokens"]) == (len(n), sum(n))
    for limit in (0, 1, 100, 512, 10**9):
        assert C.truncated_total(df, limit) == sum(min(v, limit) for v in n)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        if n:
            assert C.quantile(df, q) == next(v for v in n if sum(x <= v for x in n) >= max(1, -(-q * len(n) // 1)))


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(C.token_counts(docs).cache(), docs.collect())


def test_odd(odd, none):
    check(C.token_counts(odd).cache(), odd.collect())
    assert C.token_counts(none).count() == 0 and C.truncated_total(C.token_counts(none), 5) == 0 and C.quantile(C.token_counts(none), 0.5) is None
