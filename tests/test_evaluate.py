import pytest

from textmill.operators import evaluate as E
from textmill.operators import profile as P
from textmill.schemas import BUNDLE, SCORES


def scores(spark, rows):
    return spark.createDataFrame(rows, SCORES)


def questions(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line_no int, id string, question string, category string, ground_truth string")


def bundle(spark, rows):
    return spark.createDataFrame(rows, BUNDLE)


def ok(qid, cat="Chunking", tokens=(100, 50), s=1.0):
    return (qid, cat, ("q", "a", [("c1", "t", ("forum", "f", 0), 0.5)], ("v0", "m", "t", *tokens, s)), None)


def test_summary(spark):
    rows = [("Q001", "Chunking", 0.6, 0.5, None, 1.0), ("Q002", "Chunking", 0.8, 0.5, None, 1.0), ("Q003", "Recency", 0.9, 0.5, None, 1.0), ("Q004", "Visuals", None, 0.5, None, 1.0), ("Q005", "Strange", 0.9, 0.5, None, 1.0)]
    r = E.summary(scores(spark, rows)).collect()
    assert [x["category"] for x in r] == ["ALL", "Chunking", "Recency", "Visuals"]
    assert (r[0]["n"], r[0]["faithfulness"]) == (5, pytest.approx(0.8)) and (r[1]["n"], r[1]["faithfulness"]) == (2, pytest.approx(0.7))
    assert r[0]["context_recall"] is None and r[3]["faithfulness"] is None


def test_run_stats(spark):
    r = E.run_stats(bundle(spark, [ok("Q001"), ok("Q002"), ok("Q003"), ("Q004", "Recency", None, "boom")])).first()
    assert (r["n_total"], r["n_success"], r["n_error"], r["input_tokens"], r["output_tokens"], r["duration_s"]) == (4, 3, 1, 300, 150, 3.0)
    assert r["cost_usd"] == pytest.approx((300 * 2 + 150 * 8) / 1e6)


def test_abort(spark):
    rows = spark.range(10).selectExpr("id", "true as bad", "1 as k")
    assert E.stop_points(rows, ["id"], rows.bad, ["k"]).first()["stopped_after"] == 5
    for block in (None, rows.id - rows.id % 4, rows.id):
        r = E.running_error_rate(rows, ["id"], rows.id % 3 == 0, ["k"], block).orderBy("id").collect()
        assert [(x["n_seen"], x["n_errors"]) for x in r] == [(i + 1, i // 3 + 1) for i in range(10)]
    half = spark.range(10).selectExpr("id", "id % 2 = 0 as bad", "1 as k")
    assert E.stop_points(half, ["id"], half.bad, ["k"]).first()["stopped_after"] == 5
    good = spark.range(10).selectExpr("id", "id % 2 = 1 as bad", "1 as k")
    assert E.stop_points(good, ["id"], good.bad, ["k"]).count() == 0


def test_dry_run(spark):
    q = questions(spark, [(f"Q{i:03d}", "q", c, "") for i, c in enumerate(["Recency", "Chunking", "Chunking", "Chunking", "Visuals", "CrossSource", "Recency"])])
    assert [r["id"] for r in E.dry_run(q).collect()] == ["Q001", "Q002", "Q000", "Q004", "Q005"]
    assert [r["id"] for r in E.dry_run(q, ["Q005", "Q999", "Q000"]).collect()] == ["Q005", "Q000"]
    assert [r["category"] for r in E.by_category(q).collect()] == ["Chunking"] * 3 + ["Recency"] * 2 + ["Visuals", "CrossSource"]


def test_consistency(spark):
    q = questions(spark, [("Q001", "q", "Chunking", "x"), ("Q003", "q", "Recency", " "), ("Q003", "q", "Recency", "y")])
    r = E.consistency(q).first()
    assert tuple(r) == (3, 1, 1, 1)
    assert [x["missing"] for x in E.id_gaps(spark.createDataFrame([(1,), (3,), (3_000_000,)], "n long")).orderBy("missing").limit(3).collect()] == [2, 4, 5]
    assert E.id_gaps(spark.createDataFrame([], "n long")).count() == 0


def test_judge_rows(spark):
    q = questions(spark, [("Q001", "q", "Chunking", "truth")])
    b = bundle(spark, [ok("Q001"), ok("Q002"), ("Q003", "Recency", None, "boom")])
    r = {x["question_id"]: x for x in E.judge_rows(b, q).collect()}
    assert len(r) == 2 and r["Q001"]["reference"] == "truth" and r["Q002"]["reference"] == "" and r["Q001"]["retrieved_contexts"] == ["t"]
    with pytest.raises(ValueError):
        E.judge_rows(bundle(spark, [("Q003", "Recency", None, "boom")]), q)


def test_deltas(spark):
    m = spark.createDataFrame([("V0", "A", 0.5, 0.0, 1.0, None), ("V1", "A", 0.6, 0.3, 1.0, 0.2), ("V2", "A", 0.3, 0.3, 1.0, 0.2)], "variant string, category string, faithfulness double, answer_relevance double, context_recall double, factual_correctness double")
    r = {(x["base"], x["target"]): x for x in E.category_deltas(m).collect()}
    assert tuple(r["V0", "V1"])[3:] == ("+20.0%", None, "0.0%", None) and r["V1", "V2"]["faithfulness"] == "-50.0%" and r["V2", "V4"]["faithfulness"] is None
    p = {x["target"]: x["faithfulness"] for x in E.pairwise_deltas(m.drop("category")).collect()}
    assert p == {"V1": pytest.approx(0.1), "V2": pytest.approx(-0.3)}


def test_rescore(spark):
    old = scores(spark, [("Q1", "A", 0.1, 0.1, 0.1, 0.1), ("Q2", "A", 0.2, 0.2, 0.2, 0.2), ("Q3", "A", 0.3, 0.3, 0.3, 0.3)])
    new = spark.createDataFrame([("Q1", 0.9), ("Q2", None)], "question_id string, faithfulness double")
    get = lambda o: {r["question_id"]: r["faithfulness"] for r in E.rescored(old, new, ["faithfulness"], o).collect()}
    assert get(True) == {"Q1": 0.9, "Q2": None, "Q3": None} and get(False) == {"Q1": 0.9, "Q2": 0.2, "Q3": 0.3}
    assert not E.may_go_on(new, "faithfulness") and E.metric_column(["x", "factual_correctness(mode=f1)"], "factual_correctness") == "factual_correctness(mode=f1)"
    nan = E.clean_scores(scores(spark, [("Q1", "A", float("nan"), 0.1, None, 0.1)])).first()
    assert nan["faithfulness"] is None and nan["answer_relevance"] == 0.1


def test_missing_and_answers(spark):
    s = spark.createDataFrame([("V0", "Q001", None, 0.1, float("nan"), 0.2)], "variant string, question_id string, faithfulness double, answer_relevance double, context_recall double, factual_correctness double")
    assert {r["metric"]: r["n_missing"] for r in E.missing_scores(s).collect()} == {"faithfulness": 1, "answer_relevance": 0, "context_recall": 1, "factual_correctness": 0}
    q = questions(spark, [("Q001", "q", "Chunking", "")])
    b = E.union_variants({"v0": bundle(spark, [ok("Q001")]), "v1": bundle(spark, [("Q001", "Chunking", None, "boom")])})
    assert E.missing_detail(s, b, q).count() == 2
    a = E.answers_by_variant(q, b, ["V0", "V1", "V2"]).first()["answers"]
    assert (a["V0"]["answer"], a["V0"]["chunk_ids"], a["V1"]["error"], a["V2"]["error"], a["V2"]["n_chunks"]) == ("a", ["c1"], "boom", "not run", 0)
    assert E.latencies(b).first()["latency_ms"] == 1000.0


def test_profile(spark):
    t = spark.createDataFrame([(1, "a a a a x"), (2, "a a a a x"), (3, "a A a a y"), (4, "b"), (5, None)], "id int, text string")
    assert tuple(P.duplicates(t, "text").first()) == (2, 1)
    assert tuple(P.similar_starts(t, "text", words=4).first()) == (3, 1)
    assert tuple(P.lengths(t, "text").first())[:5] == (4, 4.0, 5.0, 1, 5)
    f = P.frequencies(t, t.id % 2, 1).collect()
    assert [(r["value"], r["n"], r["share"]) for r in f] == [(1, 3, 60.0)]
    pages = spark.createDataFrame([("d", "a b Tabelle 1", 1), ("d", "", 0), ("e", "x", 0)], "doc string, text string, n_images int")
    p = P.page_profile(pages, ["doc"])
    r = {x["doc"]: x for x in p.collect()}
    assert (r["d"]["coverage"], r["d"]["words_per_page"], r["d"]["density"], r["d"]["table_pages"], r["e"]["density"]) == (0.5, 4.0, 2.0, 1, None)
    up = {x["doc"]: x for x in P.profile_rollup(p, "doc").collect()}
    assert up["GESAMT"]["n_pages"] == 3 and up["GESAMT"]["words_per_page"] == 2.5 and P.mean_of_means(p).first()["words_per_page"] == 2.5
    images = spark.createDataFrame([(1, 50, 60), (1, 200, 100), (2, 900, 10)], "page int, width int, height int")
    assert {x["bucket"]: x["n"] for x in P.image_sizes(images).collect()} == {"<100": 1, "100-299": 1, ">=800": 1}
    assert P.images_per_page(images).count() == 2
    assert [r["id"] for r in P.systematic_sample(spark.range(10), ["id"], 3).collect()] == [0, 3, 6]
    many = spark.range(5003).selectExpr("id % 7 AS a", "5003 - id AS b").repartition(5)
    want = sorted((i % 7, 5003 - i) for i in range(5003))[:: 5003 // 40][:40]
    assert [tuple(r) for r in P.systematic_sample(many, ["a", "b"], 40).collect()] == want and P.systematic_sample(many.limit(0), ["a"], 3).count() == 0
    assert tuple(P.completeness(t, ["text"]).first()) == (5, 1)
    s = spark.createDataFrame([(0,), (86400,), (259200,)], "s long")
    assert tuple(P.time_span(s, "s").first()) == ("1970-01-02", "1970-01-04", 2)


def test_run_and_score(spark):
    q = questions(spark, [("Q001", "wie?", "Chunking", "so"), ("Q002", "was?", "Recency", "")])
    hits = spark.createDataFrame([("Q001", "c1", "antwort", "forum", "f", 0, 0.5, 1)], "query_id string, id string, text string, source_type string, source_file string, chunk_index int, similarity double, rank int")

    def model(prompts):
        return [{"error": "boom"} if "was?" in p else {"answer": "so", "input_tokens": 10, "output_tokens": 2, "duration_seconds": 0.5, "model": "m"} for p in prompts]

    b = E.run_testset(q, hits, model, "v0", "t")
    assert b.schema == BUNDLE or [f.name for f in b.schema] == [f.name for f in BUNDLE]
    r = {x["question_id"]: x for x in b.collect()}
    assert r["Q001"]["result"]["answer"] == "so" and r["Q001"]["result"]["retrieved_chunks"][0]["id"] == "c1" and r["Q001"]["error"] is None
    assert r["Q002"]["result"] is None and r["Q002"]["error"] == "boom"
    assert tuple(E.run_stats(b).first())[:5] == (2, 1, 1, 10, 2)
    s = E.score_bundle(b, q, lambda rows: [{"faithfulness": 1.0, "context_recall": float("nan")} for _ in rows]).collect()
    assert [tuple(x) for x in s] == [("Q001", "Chunking", 1.0, None, None, None)]
    assert E.check_error_rate(b).count() == 2
    bad = bundle(spark, [(f"Q{i:03d}", "Recency", None, "boom") for i in range(10)])
    with pytest.raises(RuntimeError):
        E.check_error_rate(bad)
