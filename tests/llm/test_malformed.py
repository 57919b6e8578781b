"""Malformed UTF-8 in a text stops no operator (see ``common.decoded``)."""

import pytest

import corpus_pipeline
from textmill.llm import decontaminate, language, lm_score, near_dedup, packing, perplexity, quality_rules, token_counts, toxicity


@pytest.fixture(scope="module")
def bad(spark):
    texts = ["X'61FF62'", "X'FF'", "X'E282'", "encode('ein ganzer Satz aus Wörtern', 'UTF-8')", "concat(X'C3', encode(repeat(' wort', 3000), 'UTF-8'))"]
    rows = " UNION ALL ".join(f"SELECT {i}L AS doc_id, cast({t} AS string) AS text, 'de' AS lang, 's' AS source, 1L AS n_chars" for i, t in enumerate(texts))
    return spark.sql(rows)


def test_operators(spark, bad):
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "ein ganzer Satz aus Wörtern"), (2, "wort wort")], "item_id long, text string")
    made = [
        language.identify(bad), near_dedup.near_duplicates(bad), perplexity.quality(bad, labels), decontaminate.contamination(bad, bench), quality_rules.quality_rules(bad, labels),
        lm_score.lm_scores(bad), toxicity.toxicity(bad, labels),
    ]
    assert [sorted(r["doc_id"] for r in m.collect()) for m in made] == [[0, 1, 2, 3, 4]] * 7
    r = {x["doc_id"]: x for x in made[4].collect()}
    assert [r[i]["word_chars"] for i in range(3)] == [3, 1, 1] and r[0]["n_words"] == 1
    assert made[0].where("doc_id in (1, 2)").select("lang_pred").distinct().collect()[0][0] == "und"
    assert packing.pack(bad).select("doc_id").distinct().count() == 5
    assert token_counts.token_counts(bad).selectExpr("sum(n_docs)").first()[0] == 5


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, bad, small, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, bad, small)
    assert out.count() <= 6
