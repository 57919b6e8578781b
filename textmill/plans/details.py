"""Queries on single expressions, tickets, images and response bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import lookups
from textmill.functions import text as X
from textmill.operators import chunk, enrich, evaluate, prepare, profile, retrieve
from textmill.plans.corpus import CLEAN, STRIP, TOKENS, WORDS, gold, posts
from textmill.plans.registry import query, table
from textmill.plans.search import _BM25, _SCORES, scores
from textmill.schemas import BUNDLE, METRICS
from textmill.sources import files


@query(r"""
SELECT doc_id, trim(lower(regexp_replace(source || ' Doc (' || doc_id || ')', '[^a-zA-Z0-9]+', '_', 'g')), '_') AS pdf_id,
       replace(source || '_x.y_' || doc_id, '_', ' ') AS title,
       CASE WHEN length(lang || doc_id % 3) < 3 THEN '' ELSE upper(left(lang, 1)) || lower(substr(lang || doc_id % 3, 2)) END AS module,
       coalesce(nullif(trim(substr(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), 1, 30), '_'), ''), 'query') AS slug,
       'src > ' || source AS path, CASE WHEN doc_id % 2 = 0 THEN 'dir/' || doc_id ELSE '/other/' || doc_id END AS relative
FROM documents
""")
def name_scalars(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = F.col("doc_id").cast("string")
    return d.select(
        "doc_id",
        X.doc_id_of(F.concat(F.lit("/data/raw.d/"), "source", F.lit(" Doc ("), s, F.lit(").pdf"))).alias("pdf_id"),
        X.doc_title(F.concat("source", F.lit("_x.y_"), s, F.lit(".pdf"))).alias("title"),
        X.module_of(F.concat(F.lit("schulungsunterlagen_"), "lang", (F.col("doc_id") % 3).cast("string"), F.lit("_rest"))).alias("module"),
        X.slug(F.col("text")).alias("slug"),
        X.outline_path(F.array(F.lit("src"), F.col("source"))).alias("path"),
        X.relative_path(F.concat(F.when(F.col("doc_id") % 2 == 0, "/root/x/dir\\").otherwise("/other/"), s), "/root/x").alias("relative"),
    )


@query(rf"""
SELECT doc_id::VARCHAR AS doc_id, sum(CASE WHEN n <= 2000 THEN 1 WHEN n <= 1500 THEN 1 ELSE 1 + ceil((n - 1500) / 1400.0) END)::BIGINT AS n
FROM (SELECT doc_id, len({TOKENS.format(STRIP.format("l"))}) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE {STRIP.format("l")} <> '') GROUP BY doc_id
""")
def chunk_id_parse(spark, sf_dir):
    c = chunk.by_page(gold(spark, sf_dir, "modulbeschreibung"))
    return c.groupBy(X.doc_id_of_chunk(F.col("id"), F.col("source_type")).alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, array_to_string(list_filter({WORDS}, lambda k: length(k) BETWEEN 2 AND 60), ',') AS keywords FROM documents")
def keyword_fields(spark, sf_dir):
    k = X.valid_keywords(X.split_words(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", X.joined_keywords(k).alias("keywords"))


@query(f"WITH {_BM25.format(k=5)}, dc AS (SELECT term, count(*) AS df FROM p GROUP BY term) SELECT term, df, round(idf, 9) AS idf FROM idf JOIN dc USING (term)")
def bm25_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieve.bm25_index(d, "text")["terms"].select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"""
SELECT sum(n)::BIGINT AS tokens, sum(least(n, 2000))::BIGINT AS prompt_tokens, sum(n) * 0.13::DOUBLE / 1e6 AS embedding_usd, sum(least(n, 2000)) * 0.15::DOUBLE / 1e6 AS keywords_usd,
       sum(n) * 0.13::DOUBLE / 1e6 <= 2 AND sum(least(n, 2000)) * 0.15::DOUBLE / 1e6 <= 5 AS ok FROM (SELECT len({TOKENS.format("text")}) AS n FROM documents)
""")
def cost_estimate(spark, sf_dir):
    return enrich.cost_estimate(table(spark, sf_dir, "documents").select("text"))


@query(rf"""
WITH l AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
b AS (SELECT doc_id, (i - 1) // 4 + 1 AS page, i * 10 AS y, 0 AS kind, {STRIP.format("l[i]")} AS text FROM l),
m AS (SELECT doc_id, (i - 1) // 4 + 1 AS page, i * 10 + 5 AS y, 1 AS kind, '[Bild: Bild ' || ((i - 1) // 4 + 1) || ']' AS text FROM l WHERE i % 4 = 1 AND ((i - 1) // 4 + 1) % 2 = 1)
SELECT 'schulungsunterlage__' || doc_id || '_page_' || lpad(page::VARCHAR, 4, '0') AS id, (page - 1)::INTEGER AS chunk_index, string_agg(text, chr(10) || chr(10) ORDER BY y, kind) AS text FROM (SELECT * FROM b UNION ALL SELECT * FROM m) WHERE text <> '' GROUP BY doc_id, page
""")
def image_pages(spark, sf_dir):
    """Four lines make a page; odd pages have an image below the first."""
    d = table(spark, sf_dir, "documents").select(F.lit("schulungsunterlage").alias("source_type"), F.col("doc_id").cast("string").alias("doc_id"), F.split("text", "\n").alias("l"))
    e = d.select("source_type", "doc_id", F.posexplode("l").alias("i", "text")).withColumn("page_number", F.floor(F.col("i") / 4).cast("int") + 1)
    blocks = e.select("source_type", "doc_id", "page_number", F.col("i").alias("pos"), ((F.col("i") + 1) * 10).cast("double").alias("y"), "text")
    images = e.where("i % 4 = 0").select("source_type", "doc_id", "page_number", F.lit(1).alias("index"), ((F.col("i") + 1) * 10 + 5).cast("double").alias("y"))
    page = F.col("page_number").cast("string")
    said = images.where("page_number % 2 = 1").select(F.format_string("schulung_auftrag_einsteiger_p%03d_img01", "page_number").alias("image_id"), F.concat(F.lit("Bild "), page).alias("vlm_description")).distinct()
    merged = chunk.merge_images(blocks, images, said)
    pages = F.transform(F.sequence(F.lit(1), F.ceil(F.size("l") / 4).cast("int")), lambda p: F.struct(p.alias("page_number"), F.lit("").alias("text")))
    docs = d.select("source_type", "doc_id", F.struct(F.lit("b.pdf").alias("filename")).alias("metadata"), F.struct(F.lit("").alias("full_text"), F.array().cast("array<struct<level:int,title:string,page:int>>").alias("outline"), pages.alias("pages")).alias("content"))
    return chunk.by_page_with_images(docs, merged).select("id", "chunk_index", "text")


@query("SELECT p_partkey, round(p_size * 20 / greatest(p_size % 7, 1), 2) AS ratio, greatest(p_size * 20, p_size % 7) >= 300 AS relevant, 'data:image/png;base64,' || base64(encode(p_name)) AS url FROM part")
def image_scalars(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("w", F.col("p_size") * 20).withColumn("h", F.col("p_size") % 7)
    return p.select("p_partkey", X.aspect_ratio(F.col("w"), F.col("h")).alias("ratio"), X.is_relevant_image(F.col("w"), F.col("h")).alias("relevant"), X.data_url(F.lit("png"), F.encode("p_name", "UTF-8")).alias("url"))


@query("WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () // 25 AS step FROM part) SELECT p_partkey FROM r WHERE i % step = 0 AND i // step < 25")
def systematic_sample(spark, sf_dir):
    return profile.systematic_sample(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], 25)


@query()
def hash_sample(spark, sf_dir):
    """A reproducible sample: the feature is the limit."""
    return files.sampled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace({}, '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_SIGNATURE = r"regexp_replace(regexp_replace({}, '(?is)\n--\s*\n.*$|\nMit freundlichen Gr[uü]ssen.*$|\nMit freundlichen Gr[uü]ßen.*$|\nBest regards.*$|\nKind regards.*$|\nFreundliche Gr[uü]sse.*$', ''), '^\s+|\s+$', '', 'g')"
_TICKET = _NORMAL.format("regexp_replace(" + _SIGNATURE.format(_NORMAL.format("text")) + ", '<[^>]+>', '', 'g')")
_TICKETS = f"""t AS (SELECT conv_id || '_' || turn AS id, role, {_TICKET} AS solution, coalesce(p.label, (turn % 40)::VARCHAR) AS product, coalesce(s.label, (turn % 13)::VARCHAR) AS status FROM conversations
  LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in lookups.PRODUCTS.items())}) AS p(code, label) ON p.code = (turn % 40)::VARCHAR
  LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in lookups.TICKET_STATES.items())}) AS s(code, label) ON s.code = (turn % 13)::VARCHAR)"""


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    blank = {n: F.lit("") for n in ("KATEGORIE", "VERSION", "VERSIONERL", "FEHLER")}
    return prepare.ticket_silver(
        c.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ID"), *[v.alias(n) for n, v in blank.items()], F.col("role").alias("BESCHREIBU"), (F.col("turn") % 40).cast("string").alias("PRODUKTID"), F.col("text").alias("LOESUNG"), (F.col("turn") % 13).cast("string").alias("STATUSID"), F.lit("2024-05-06 07:08").alias("BEARBEITET")),
        entities=False,
    )


@query(f"WITH {_TICKETS} SELECT id, solution, product, status, '2024-05-06' AS processed_date FROM t WHERE solution <> ''")
def ticket_silver(spark, sf_dir):
    return _tickets(spark, sf_dir).select(F.col("ID").alias("id"), F.col("LOESUNG").alias("solution"), "product", "status", "processed_date")


@query(f"WITH {_TICKETS} SELECT 'ticket_' || id AS doc_id, role || chr(10) || chr(10) || 'Fehlerbeschreibung:' || chr(10) || chr(10) || chr(10) || 'Lösung:' || chr(10) || solution AS full_text, product FROM t WHERE solution <> ''")
def ticket_gold(spark, sf_dir):
    return prepare.ticket_gold(_tickets(spark, sf_dir)).select("doc_id", "content.full_text", "metadata.product")


@query(f"SELECT 'forum_' || doc_id AS doc_id, source || chr(10) || chr(10) || t AS full_text FROM (SELECT doc_id, source, t, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS n FROM (SELECT doc_id, source, {CLEAN} AS t FROM documents) WHERE t <> '') WHERE n = 1")
def forum_gold(spark, sf_dir):
    return prepare.forum_gold(prepare.forum_silver(posts(spark, sf_dir))).select("doc_id", "content.full_text")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE::VARCHAR WHEN 1 THEN o_orderdate::DATE::VARCHAR END AS day FROM orders")
def iso_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 4 == 0, day).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" "), day, F.lit("T10:00"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("d"), day)).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.iso_date(raw).cast("string").alias("day"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of five variants: a third of the rows is an error."""
    s = scores(spark, sf_dir).select("variant", "question_id", "category", F.col("context_recall").alias("chars"))
    bad = F.col("question_id") % 3 == 0
    kind = BUNDLE["result"].dataType
    hit = F.struct(F.concat(F.lit("c"), F.col("question_id").cast("string")).alias("id"), F.lit("t").alias("text"), F.lit(None).cast(kind["retrieved_chunks"].dataType.elementType["metadata"].dataType).alias("metadata"), F.lit(0.5).alias("similarity"))
    run = F.struct(F.col("variant"), F.lit("m").alias("model"), F.lit("t").alias("timestamp"), F.col("chars").cast("long").alias("input_tokens"), (F.col("question_id") % 11).alias("output_tokens"), (F.col("question_id") % 7).cast("double").alias("duration_seconds"))
    result = F.struct(F.lit("q").alias("query"), F.concat(F.lit("a"), F.col("question_id").cast("string")).alias("answer"), F.array(hit).alias("retrieved_chunks"), run.alias("metadata"))
    return s.select("variant", F.col("question_id").cast("string").alias("question_id"), "category", F.when(~bad, result).alias("result"), F.when(bad, "boom").alias("error"))


@query(f"""WITH {_SCORES} SELECT count(*) AS n_total, count(*) FILTER (question_id % 3 <> 0) AS n_success, count(*) FILTER (question_id % 3 = 0) AS n_error, sum(context_recall)::BIGINT AS input_tokens,
(sum(question_id % 11) FILTER (question_id % 3 <> 0))::BIGINT AS output_tokens, (sum(question_id % 7) FILTER (question_id % 3 <> 0))::DOUBLE AS duration_s,
(sum(context_recall) * 2.0 + sum(question_id % 11) FILTER (question_id % 3 <> 0) * 8.0) / 1e6 AS cost_usd FROM s""")
def run_stats(spark, sf_dir):
    return evaluate.run_stats(bundles(spark, sf_dir))


@query(f"""WITH {_SCORES} SELECT variant, question_id::VARCHAR AS question_id, (question_id % 7) * 1000.0::DOUBLE AS latency_ms FROM s WHERE question_id % 3 <> 0""")
def latency_rows(spark, sf_dir):
    return evaluate.latencies(bundles(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("question"), F.lit("Chunking").alias("category"), F.lit("g").alias("ground_truth"), F.col("doc_id").alias("line_no"))


@query("""SELECT d.doc_id::VARCHAR AS id, v.variant, CASE WHEN run AND d.doc_id % 3 <> 0 THEN 'a' || d.doc_id ELSE '' END AS answer, CASE WHEN run AND d.doc_id % 3 <> 0 THEN 1 ELSE 0 END AS n_chunks,
CASE WHEN NOT run THEN 'not run' WHEN d.doc_id % 3 = 0 THEN 'boom' END AS error
FROM (SELECT d.doc_id, v.variant, v.variant = 'V' || (d.doc_id % 5) AS run FROM documents d, (VALUES ('V0'), ('V1'), ('V2'), ('V3'), ('V4')) AS v(variant)) AS d, (SELECT 1) AS one, LATERAL (SELECT d.variant AS variant) AS v""")
def consolidated_answers(spark, sf_dir):
    a = evaluate.answers_by_variant(_asked(spark, sf_dir), bundles(spark, sf_dir), ["V0", "V1", "V2", "V3", "V4"])
    return a.select("id", F.explode("answers").alias("variant", "r")).select("id", "variant", "r.answer", "r.n_chunks", "r.error")


@query("SELECT d.doc_id::VARCHAR AS question_id, 'a' || d.doc_id AS response, 'g' AS reference, 1 AS n_contexts FROM documents d WHERE d.doc_id % 3 <> 0")
def judge_rows(spark, sf_dir):
    r = evaluate.judge_rows(bundles(spark, sf_dir), _asked(spark, sf_dir))
    return r.select("question_id", "response", "reference", F.size("retrieved_contexts").alias("n_contexts"))


@query(f"""WITH {_SCORES}, u AS ({" UNION ALL ".join(f"SELECT variant, question_id, '{m}' AS metric, {m} AS v FROM s" for m in METRICS)})
SELECT variant, question_id::VARCHAR AS question_id, metric, CASE WHEN question_id % 3 <> 0 THEN 'a' || question_id END AS answer, CASE WHEN question_id % 3 = 0 THEN 'boom' END AS error, 'Chunking' AS category FROM u WHERE v IS NULL""")
def missing_detail(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("question_id", F.col("question_id").cast("string"))
    m = evaluate.missing_detail(s, bundles(spark, sf_dir), _asked(spark, sf_dir))
    return m.select("variant", "question_id", "metric", "answer", "error", "category")


@query("""WITH q AS (SELECT doc_id // 2 * 3 AS n, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'g' END AS g FROM documents)
SELECT count(*) AS n_questions, count(*) - count(DISTINCT n) AS n_duplicates, count(*) FILTER (g = '') AS n_without_ground_truth, (max(n) - min(n) + 1 - count(DISTINCT n))::BIGINT AS n_gaps FROM q""")
def question_consistency(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = (F.floor(F.col("doc_id") / 2) * 3).cast("string")
    return evaluate.consistency(d.select(F.concat(F.lit("Q"), n).alias("id"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("g").alias("ground_truth")))


@query("SELECT category, row_number() OVER (ORDER BY p) AS pos, n FROM (SELECT category, list_position(['Chunking', 'Recency', 'Visuals', 'CrossSource'], category) AS p, count(*) AS n FROM (SELECT ['Chunking', 'Recency', 'Visuals', 'CrossSource', 'Other'][(doc_id // 5) % 5 + 1] AS category FROM documents) WHERE category <> 'Other' GROUP BY category)")
def category_distribution(spark, sf_dir):
    """Questions per known category with its place in the fixed order."""
    s = scores(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return s.select("category", evaluate.category_order(F.col("category")).alias("pos"), "n").where("pos > 0")
