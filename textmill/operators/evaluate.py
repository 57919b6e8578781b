"""Question sets, response bundles, scores and their aggregates."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import providers
from textmill.functions import text as X
from textmill.operators import retrieve, select
from textmill.schemas import BUNDLE, METRICS
from textmill.sources import files
from textmill.sources.files import CATEGORIES

# Compared variants, and prices in USD per million tokens.
COMPARISONS = (("V0", "V1"), ("V1", "V2"), ("V2", "V3"), ("V2", "V4"))
INPUT_PRICE, OUTPUT_PRICE = 2.00, 8.00
ABORT_RATE, ABORT_AFTER = 0.5, 5


def category_order(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in CATEGORIES]), c)


def by_category(questions: DataFrame) -> DataFrame:
    """Questions of the known categories in their fixed order."""
    return questions.where(F.col("category").isin(*CATEGORIES)).orderBy(category_order(F.col("category")), "line_no")


def dry_run(questions: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """A small selection with its position: the given ids, in their order, or
    the first question of each category and two of the first category."""
    if ids:
        wanted = questions.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, id string")
        return questions.join(F.broadcast(wanted), "id").orderBy("pos")
    w = Window.partitionBy("category").orderBy("line_no")
    n = F.when(F.col("category") == CATEGORIES[0], 2).otherwise(1)
    q = questions.where(F.col("category").isin(*CATEGORIES)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return q.withColumn("pos", (category_order(F.col("category")) * 10 + F.col("_n")).cast("int")).drop("_n").orderBy("pos")


def id_gaps(ids: DataFrame, col: str = "n") -> DataFrame:
    """Numbers between the least and the greatest that are not there. Gaps are
    made from neighbours, so only missing numbers are ever listed."""
    block = 1 << 20
    d = ids.select(F.col(col).cast("long").alias("n")).where("n is not null").distinct().withColumn("block", F.floor(F.col("n") / block))
    inner = d.withColumn("next", F.lead("n").over(Window.partitionBy("block").orderBy("n"))).where("next is not null")
    edges = d.groupBy("block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))  # one row per million ids
    outer = edges.select(F.col("hi").alias("n"), F.lead("lo").over(Window.orderBy("block")).alias("next")).where("next is not null")
    return inner.select("n", "next").unionByName(outer).where("next > n + 1").select(F.explode(F.sequence(F.col("n") + 1, F.col("next") - 1)).alias("missing"))


def duplicate_ids(questions: DataFrame) -> DataFrame:
    return questions.groupBy("id").count().where("count > 1")


def consistency(questions: DataFrame) -> DataFrame:
    """n_questions, n_duplicates, n_without_ground_truth, n_gaps."""
    head = questions.agg(F.count(F.lit(1)).alias("n_questions"), (F.count(F.lit(1)) - F.countDistinct("id")).alias("n_duplicates"), F.count_if(X.is_blank(F.col("ground_truth"))).alias("n_without_ground_truth"))
    gaps = id_gaps(questions.select(F.substring("id", 2, 10).try_cast("long").alias("n"))).agg(F.count(F.lit(1)).alias("n_gaps"))
    return head.crossJoin(F.broadcast(gaps))


def run_stats(bundle: DataFrame) -> DataFrame:
    """Successes, errors, summed tokens and seconds, and the answers' cost."""
    m = "result.metadata"
    ok = F.col("error").isNull()
    add = lambda c: F.coalesce(F.sum(F.when(ok, F.col(f"{m}.{c}"))), F.lit(0))
    t = bundle.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_error"), add("input_tokens").alias("input_tokens"), add("output_tokens").alias("output_tokens"), add("duration_seconds").cast("double").alias("duration_s"))
    return t.withColumn("cost_usd", (F.col("input_tokens") * INPUT_PRICE + F.col("output_tokens") * OUTPUT_PRICE) / 1e6)


def running_error_rate(rows: DataFrame, order: list[str], failed: Column, keys: list[str], block: Column | None = None) -> DataFrame:
    """Adds n_seen, n_errors and stop (the rate is above the limit after
    enough rows), running within each key.

    ``block`` (a number that never falls in the order) lets a key of any size
    run in many tasks: sums run within blocks, and over the blocks' totals.
    """
    bad = F.coalesce(failed, F.lit(False)).cast("int")
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        r = rows.withColumn("n_seen", F.count(F.lit(1)).over(w)).withColumn("n_errors", F.sum(bad).over(w))
    else:
        b = rows.withColumn("_block", block).withColumn("_bad", bad)
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = b.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("e"))
        sums = sums.select(*keys, "_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "e")])
        w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        r = b.withColumn("n_seen", F.count(F.lit(1)).over(w)).withColumn("n_errors", F.sum("_bad").over(w)).join(sums, [*keys, "_block"])
        r = r.withColumn("n_seen", F.col("n_seen") + F.col("_n")).withColumn("n_errors", F.col("n_errors") + F.col("_e")).select(*rows.columns, "n_seen", "n_errors")
    return r.withColumn("stop", (F.col("n_seen") >= ABORT_AFTER) & (F.col("n_errors") / F.col("n_seen") > ABORT_RATE))


def stop_points(rows: DataFrame, order: list[str], failed: Column, keys: list[str], block: Column | None = None) -> DataFrame:
    """The first row of each key at which a run stops; for ``block`` see
    ``running_error_rate``."""
    return running_error_rate(rows, order, failed, keys, block).where("stop").groupBy(*keys).agg(F.min("n_seen").alias("stopped_after"))


def run_testset(questions: DataFrame, hits: DataFrame, provider: Callable, variant: str, timestamp: str, rank: str = "rank") -> DataFrame:
    """Bundle rows of all questions in one job. hits: the retrieval's rows
    with query_id = the question's id. ``provider(list of prompts)`` gives
    {answer, input_tokens, output_tokens, duration_seconds, model} per prompt,
    or {error}; a failure of one question is its row's error."""
    q = questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    call = lambda prompts: [json.dumps(r) for r in provider(prompts)]
    made = providers.apply(retrieve.messages(q, hits, rank), "prompt", "reply", "string", call, batch=1)
    kind = "answer string, error string, model string, input_tokens bigint, output_tokens bigint, duration_seconds double"
    made = made.select("query_id", F.from_json("reply", kind).alias("r"))
    hit = F.struct("id", "text", F.struct("source_type", "source_file", F.col("chunk_index").cast("int").alias("chunk_index")).alias("metadata"), F.col("similarity").cast("double").alias("similarity"))
    found = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("k"), hit.alias("h")))), lambda e: e["h"]).alias("found"))
    j = questions.select(F.col("id").alias("query_id"), "question", "category").join(made, "query_id").join(found, "query_id", "left")
    run = F.struct(F.lit(variant).alias("variant"), "r.model", F.lit(timestamp).alias("timestamp"), "r.input_tokens", "r.output_tokens", "r.duration_seconds")
    result = F.struct(F.col("question").alias("query"), "r.answer", F.coalesce("found", F.array().cast(BUNDLE["result"].dataType["retrieved_chunks"].dataType)).alias("retrieved_chunks"), run.alias("metadata"))
    return j.select(F.col("query_id").alias("question_id"), "category", F.when(F.col("r.error").isNull(), result).cast(BUNDLE["result"].dataType).alias("result"), F.col("r.error").alias("error"))


def check_error_rate(bundle: DataFrame) -> DataFrame:
    """The bundle itself, or an error if a run in order of question would
    have stopped."""
    w = bundle.withColumn("_run", F.lit(1)).withColumn("_no", F.coalesce(F.substring("question_id", 2, 18).try_cast("long"), F.lit(0)))
    if not stop_points(w, ["_no", "question_id"], F.col("error").isNotNull(), ["_run"], F.floor(F.col("_no") / 1000)).isEmpty():
        raise RuntimeError("more than half of the questions failed")
    return bundle


def run_in_batches(questions: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, size: int = 50) -> bool:
    """Writes the bundle of a run batch by batch, in order of line, each of the
    questions of ``size`` lines and in a folder of its own; whether it came to
    the end. ``run(questions)`` gives bundle rows.

    A batch that is whole is not run again, and one that was torn is replaced,
    so a run that was killed goes on with each question there once. After a
    batch the run stops if, from the first question on, too many have failed
    (``ABORT_RATE``, after ``ABORT_AFTER``); what was written stays.
    """
    spark, seen, errors = questions.sparkSession, 0, 0
    last = questions.agg(F.max("line_no")).first()[0] or 0
    for n in range(-(-last // size)):
        part = f"{path}/batch={n:06d}"
        if not files.exists(spark, f"{part}/_SUCCESS"):
            run(questions.where((F.col("line_no") > n * size) & (F.col("line_no") <= (n + 1) * size))).write.mode("overwrite").json(part)
        r = files.bundle_jsonl(spark, part).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("e")).first()
        seen, errors = seen + r["n"], errors + r["e"]
        if seen >= ABORT_AFTER and errors / seen > ABORT_RATE:
            return False
    return True


def score_bundle(bundle: DataFrame, questions: DataFrame, judge: Callable) -> DataFrame:
    """Score rows by key (never by position). ``judge(list of JSON rows)``
    gives a dict of metrics per row; missing, unreadable and NaN values are
    null. The engine owns filter, join and clean-up, the judge the verdict."""
    rows = judge_rows(bundle, questions)
    packed = rows.select("question_id", "category", F.to_json(F.struct("user_input", "response", "retrieved_contexts", "reference")).alias("row"))
    call = lambda texts: [json.dumps({k: v for k, v in r.items() if v == v}) for r in judge(texts)]
    made = providers.apply(packed, "row", "verdict", "string", call)
    return made.select("question_id", "category", *[F.from_json("verdict", f"{m} double")[m].alias(m) for m in METRICS])


def judge_rows(bundle: DataFrame, questions: DataFrame) -> DataFrame:
    """The judge's input: answered questions with contexts and reference; no
    answered question raises when the rows are read."""
    ok = bundle.where("error is null and result is not null")
    if ok.isEmpty():
        raise ValueError("no answered question in the bundle")
    return ok.join(questions.select(F.col("id").alias("question_id"), "ground_truth"), "question_id", "left").select(
        "question_id", "category", F.col("result.query").alias("user_input"), F.col("result.answer").alias("response"), F.transform("result.retrieved_chunks", lambda c: c["text"]).alias("retrieved_contexts"), F.coalesce("ground_truth", F.lit("")).alias("reference")
    )


def clean_scores(scores: DataFrame) -> DataFrame:
    """NaN to null in every metric."""
    return scores.withColumns({m: F.when(~F.isnan(m), F.col(m)) for m in METRICS})


def metric_column(columns: list[str], metric: str) -> str | None:
    """The judge's column for a metric: the name itself, else the first that
    contains it."""
    return metric if metric in columns else next((c for c in columns if metric in c), None)


def summary(scores: DataFrame) -> DataFrame:
    """Per known category, in order, and ALL (which counts others too)."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in METRICS]]
    r = scores.rollup("category").agg(F.grouping("category").alias("_all"), *aggs)
    r = r.withColumn("category", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category"))).where((F.col("_all") == 1) | F.col("category").isin(*CATEGORIES))
    return r.orderBy(F.desc("_all"), category_order(F.col("category"))).drop("_all")


def variant_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("variant").agg(*[F.round(F.avg(m), 4).alias(m) for m in METRICS])


def category_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("variant", "category").agg(*[F.round(F.avg(m), 4).alias(m) for m in METRICS])


def category_counts(scores: DataFrame) -> DataFrame:
    """"valid/total" per variant, category and metric."""
    return scores.groupBy("variant", "category").agg(*[F.concat_ws("/", F.count(m).cast("string"), F.count(F.lit(1)).cast("string")).alias(m) for m in METRICS])


def _pairs(df: DataFrame) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(list(COMPARISONS), "base string, target string"))


def pairwise_deltas(means: DataFrame) -> DataFrame:
    """target - base of the rounded means, for the compared variants."""
    b = means.select(F.col("variant").alias("base"), *[F.col(m).alias(f"b_{m}") for m in METRICS])
    t = means.select(F.col("variant").alias("target"), *[F.col(m).alias(f"t_{m}") for m in METRICS])
    return _pairs(means).join(b, "base").join(t, "target").select("base", "target", *[F.round(F.col(f"t_{m}") - F.col(f"b_{m}"), 4).alias(m) for m in METRICS])


def means_and_deltas(scores: DataFrame) -> DataFrame:
    """kind, label and the metrics: the variants' means, and below them the
    changes between compared variants, as one table."""
    means = variant_means(scores)
    deltas = pairwise_deltas(means).select(F.lit("delta").alias("kind"), F.concat_ws(" - ", "target", "base").alias("label"), *METRICS)
    return means.select(F.lit("mean").alias("kind"), F.col("variant").alias("label"), *METRICS).unionByName(deltas)


def category_deltas(means: DataFrame) -> DataFrame:
    """Signed percent changes per category; null where a side is missing or
    the base is zero."""
    cats = means.select("category").distinct()
    b = means.select(F.col("variant").alias("base"), "category", *[F.col(m).alias(f"b_{m}") for m in METRICS])
    t = means.select(F.col("variant").alias("target"), "category", *[F.col(m).alias(f"t_{m}") for m in METRICS])
    j = cats.crossJoin(_pairs(means)).join(b, ["base", "category"], "left").join(t, ["target", "category"], "left")
    change = lambda m: (F.col(f"t_{m}") - F.col(f"b_{m}")) / F.nullif(F.col(f"b_{m}"), F.lit(0.0)) * 100
    return j.select("base", "target", "category", *[X.signed_percent(change(m)).alias(m) for m in METRICS])


def pivot(means: DataFrame, metric: str, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """variant x category of one metric."""
    return means.groupBy("variant").pivot("category", list(categories)).agg(F.first(metric))


def latencies(bundle: DataFrame) -> DataFrame:
    """Milliseconds of the answered questions that have a duration."""
    ms = F.col("result.metadata.duration_seconds") * 1000
    return bundle.select("variant", "question_id", ms.alias("latency_ms")).where("latency_ms is not null")


def latency_profile(rows: DataFrame, key: str = "variant", value: str = "latency_ms", accuracy: int | None = None) -> DataFrame:
    """n, mean and the five numbers of a box plot, of the finite values.
    Percentiles are exact (see ``select``), in several passes; with
    ``accuracy`` they come from a sketch, in one."""
    q = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    own = rows.select(key, select.finite(F.col(value)).alias("v")).where("v is not null")
    base = own.groupBy(F.struct(key).alias("key"))
    if accuracy is None:
        p = base.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).join(select.percentiles(own, [key], "v", q), "key")
    else:
        p = base.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.percentile_approx("v", list(q.values()), accuracy).alias("p")).select("*", *[F.col("p")[i].alias(n) for i, n in enumerate(q)])
    return p.select(F.col("key")[key].alias(key), "n", "mean", *q)


def missing_scores(scores: DataFrame) -> DataFrame:
    """Missing values per variant and metric (unpivoted)."""
    u = scores.unpivot(["variant", "question_id"], list(METRICS), "metric", "value")
    return u.groupBy("variant", "metric").agg(F.count_if(X.is_missing(F.col("value"))).alias("n_missing"), F.count(F.lit(1)).alias("n_total"))


def missing_detail(scores: DataFrame, bundle: DataFrame, questions: DataFrame) -> DataFrame:
    """Each missing value with its question and answer."""
    u = scores.unpivot(["variant", "question_id"], list(METRICS), "metric", "value").where(X.is_missing(F.col("value")))
    b = bundle.select("variant", "question_id", F.col("result.answer").alias("answer"), "error")
    return u.drop("value").join(b, ["variant", "question_id"], "left").join(questions.select(F.col("id").alias("question_id"), "question", "category"), "question_id", "left")


def rescored(old: DataFrame, new: DataFrame, metrics: list[str], overwrite: bool) -> DataFrame:
    """Scores with newly judged metrics: ``overwrite`` takes the new value,
    nulls too; else a new null keeps the old value. Rows without a new score
    get null under ``overwrite``."""
    keys = [c for c in ("variant", "question_id") if c in old.columns and c in new.columns]
    n = new.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    pick = lambda m: F.col(f"_{m}") if overwrite else F.coalesce(F.col(f"_{m}"), F.col(m))
    return old.join(n, keys, "left").withColumns({m: pick(m) for m in metrics}).select(*old.columns)


def may_go_on(new: DataFrame, metric: str, least: float = 0.8) -> bool:
    """Whether a first rescored variant succeeded often enough."""
    r = new.agg(F.count(metric).alias("ok"), F.count(F.lit(1)).alias("n")).first()
    return bool(r["n"]) and r["ok"] / r["n"] >= least


def answers_by_variant(questions: DataFrame, bundles: DataFrame, variants: list[str]) -> DataFrame:
    """One row per question: its record for every variant. A missing or
    failed run has an empty answer, its error and no chunks."""
    grid = questions.select("id", "question", "category", "ground_truth").crossJoin(F.broadcast(questions.sparkSession.createDataFrame([(v,) for v in variants], "variant string")))
    b = bundles.select("variant", F.col("question_id").alias("id"), "result", "error", F.lit(True).alias("_run"))
    good = F.col("error").isNull() & F.col("result").isNotNull()
    record = F.struct(
        F.when(good, F.col("result.answer")).otherwise("").alias("answer"),
        F.when(good, F.transform("result.retrieved_chunks", lambda c: c["id"])).otherwise(F.array().cast("array<string>")).alias("chunk_ids"),
        F.when(good, F.size("result.retrieved_chunks")).otherwise(0).alias("n_chunks"),
        F.when(F.col("_run").isNull(), "not run").otherwise(F.col("error")).alias("error"),
    )
    j = grid.join(b, ["variant", "id"], "left")
    return j.groupBy("id", "question", "category", "ground_truth").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("variant", record.alias("record"))))).alias("answers"))


def footnotes(notes: Column) -> Column:
    """Notes without repeats, in order."""
    return F.array_distinct(notes)


def with_ground_truth(rows: DataFrame) -> DataFrame:
    """Adds the ground_truth column to rows of an older question set."""
    return rows.withColumn("ground_truth", F.coalesce("ground_truth", F.lit("")) if "ground_truth" in rows.columns else F.lit(""))


def union_variants(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("variant", F.lit(v.upper())) for v, df in parts.items()])
