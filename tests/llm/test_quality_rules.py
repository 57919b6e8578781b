from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill.llm import quality_rules as Q


def brute(t):
    w = [x for x in (t or "").encode().split()]
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum((t or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": len(hit)}


def compare(texts):
    got = Q.base_counts([None if t is None else t.encode() for t in texts])
    assert [{k: int(v[i]) for k, v in got.items()} for i in range(len(texts))] == [brute(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(["a", "b", "ü", "#", " ", " ", "\n", "\t", "\xa0"]), max_size=60).map("".join), max_size=6))
def test_base_counts(texts):
    compare(texts)


def test_base_on_documents(spark, small):
    compare([r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_query(spark, small):
    d, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    r = {x["doc_id"]: x for x in Q.quality_rules(d, labels).collect()}
    texts = {x["doc_id"]: x["text"] for x in d.collect()}
    for i, x in r.items():
        b = brute(texts[i])
        assert all(x[k] == v for k, v in b.items())
        assert x["base_failed"] == (b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"]) and not (x["base_failed"] and x["kept"])
    good = [r[x["doc_id"]] for x in labels.where("quality = 1").collect()]
    bad = [r[x["doc_id"]] for x in labels.where("quality = 0").collect()]
    assert np.mean([x["kept"] for x in good if not x["base_failed"]]) >= 0.98 and np.mean([x["kept"] for x in bad]) <= 0.4


def test_ratio_is_that_of_the_counts(spark, make):
    texts = ["a b c", "a b", None, "c c c"]
    raw = Q.count_features(make(texts).selectExpr("cast(text as binary) as text"), 64)
    want = np.zeros(128, np.int64)
    for t in texts:
        np.add.at(want, Q.features((t or "").encode(), 64), 1)
    assert (raw == want).all()
    ratios = Q.log_ratios(raw, raw)
    assert abs(ratios).max() < 1e-12 and Q.llr(b"", ratios) == 0.0


def test_odd(odd, none, no_labels, spark):
    assert Q.quality_rules(odd, no_labels).count() == odd.count()
    assert Q.quality_rules(none, no_labels).count() == 0
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, None), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    r = Q.quality_rules(odd, labels).collect()
    assert len(r) == odd.count() and not any(x["kept"] for x in r if x["n_words"] < 10)


def test_target_and_threshold_come_from_every_trusted_text(spark, monkeypatch):
    """No trusted text is left out, however many there are."""
    seen = []
    rows_of = Q.rows_of
    monkeypatch.setattr(Q, "rows_of", lambda *a: seen.append(rows_of(*a)) or seen[-1])
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('w', id % 7, ' w', id % 5, repeat(' x', 9)) as text").repartition(4)
    labels = docs.selectExpr("doc_id", "if(doc_id % 12 = 0, 0, 1) as quality")
    found = Q.quality_rules(docs, labels)
    assert seen[0].count() == 11_000 and found.count() == 12_000
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    trains = {r["doc_id"] for r in docs.where("pmod(xxhash64(doc_id), 3) <> 0 and doc_id % 12 <> 0").collect()}

    def counts(ids):
        out = np.zeros(2 * Q.BUCKETS, np.int64)
        for i in ids:
            np.add.at(out, Q.features(texts[i]), 1)
        return out

    ratios = Q.log_ratios(counts(trains), counts(texts)).astype(np.float32)
    low, mid = np.quantile([Q.llr(t, ratios) for i, t in texts.items() if i % 12 and i not in trains], [Q.QUANTILE, 0.5])
    for r in found.collect():
        s = Q.llr(texts[r["doc_id"]], ratios)
        assert abs(r["score"] - s) < 1e-9 and r["kept"] == (not r["base_failed"] and s >= low - Q.SLACK * (mid - low))
