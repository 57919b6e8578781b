"""Queries through files and through whole runs.

Each writes the driver's tables in the form of a source, reads that with the
source's reader and goes on from there; or runs a chain of operators to its
end, with stand-in providers that SQL can follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import lookups
from textmill.operators import chunk, enrich, evaluate, prepare, retrieve
from textmill.plans.corpus import CLEAN, KEYWORDS, STRIP, TOKENS, gold, made_keywords, posts
from textmill.plans.registry import query, table
from textmill.plans.search import _BM25, _SCORES, _asked, _index, _lexical, scores
from textmill.schemas import METRICS
from textmill.sources import dbf, files, sinks
from textmill.storage import scratch, written

_MODULES = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in lookups.FORUM_MODULES.items())
_POSTS = f"""
posts AS (SELECT doc_id, source, t, strftime(DATE '1970-01-01' + doc_id::INTEGER, '%Y-%m-%d') AS post_date, coalesce(label, (doc_id % 90)::VARCHAR) AS module
  FROM (SELECT doc_id, source, {CLEAN} AS t, row_number() OVER (PARTITION BY {CLEAN} ORDER BY doc_id) AS n FROM documents) LEFT JOIN (VALUES {_MODULES}) AS l(code, label) ON code = (doc_id % 90)::VARCHAR
  WHERE t <> '' AND n = 1)
"""


def _forum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts as a forum export of several files, read again and made gold."""
    path = scratch(spark)
    own = posts(spark, sf_dir)
    cells = [F.lit("")] * files.FORUM_WIDTH
    for name, at in files.FORUM_COLUMNS.items():
        cells[at] = F.col(name).cast("string")
    rows = own.repartitionByRange(4, "src_pos").sortWithinPartitions("src_pos").select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    rows.write.csv(path, sep=";", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return prepare.forum_gold(prepare.forum_silver(files.forum_csv(spark, path)))


@query(f"WITH {_POSTS} SELECT 'forum_' || doc_id AS doc_id, doc_id::VARCHAR AS post_id, module, post_date, source || chr(10) || chr(10) || t AS full_text FROM posts")
def forum_export(spark, sf_dir):
    return _forum(spark, sf_dir).select("doc_id", "metadata.post_id", "metadata.module", "metadata.post_date", "content.full_text")


_FORUM_CHUNKS = rf"""
g AS (SELECT 'forum_' || doc_id AS doc_id, doc_id::VARCHAR AS post_id, module, post_date, source || chr(10) || chr(10) || t AS text FROM posts),
t AS (SELECT *, {TOKENS.format("text")} AS t FROM g),
chunks AS (SELECT 'forum__' || doc_id || CASE WHEN len(t) <= 8000 THEN '' ELSE '_overflow_recursive_' || lpad(i::VARCHAR, 4, '0') END AS id, doc_id, post_id, module, post_date,
       CASE WHEN len(t) <= 8000 THEN text ELSE array_to_string(list_slice(t, i * 1400 + 1, i * 1400 + 1500), '') END AS text
FROM (SELECT *, unnest(range(CASE WHEN len(t) <= 8000 THEN 1 ELSE 1 + ceil((len(t) - 1500) / 1400.0)::BIGINT END)) AS i FROM t))
"""


@query(f"WITH {_POSTS}, {_FORUM_CHUNKS} SELECT id, post_id, '1' AS topic_id, module AS module_lookup, post_date, text FROM chunks")
def forum_chunks(spark, sf_dir):
    """From the export to chunks with the forum's metadata."""
    g = _forum(spark, sf_dir)
    return enrich.with_metadata(chunk.v1(g), g).select("id", "post_id", "topic_id", "module_lookup", "post_date", "text")


@query(f"""WITH {_POSTS}, {_FORUM_CHUNKS}, {KEYWORDS} SELECT id, coalesce(array_to_string(k, ','), '') AS keywords, post_date FROM chunks LEFT JOIN keyed ON id = 'forum__forum_' || keyed.doc_id""")
def chunks_v2(spark, sf_dir):
    """The v2 chunker with a keyword cache that was appended to twice, the
    second time with some chunks anew: the last append wins."""
    path = scratch(spark)
    keys = made_keywords(spark, sf_dir).withColumn("chunk_id", F.concat(F.lit("forum__forum_"), "chunk_id"))
    sinks.append_cache(keys.withColumn("keywords", F.when(F.crc32("chunk_id") % 2 == 0, F.array(F.lit("alt"))).otherwise(F.col("keywords"))), path)
    sinks.append_cache(keys.where(F.crc32("chunk_id") % 2 == 0), path)
    cache = files.keyword_cache(spark, path)
    return enrich.v2(_forum(spark, sf_dir), cache, gate=False).select("id", "keywords", "post_date")


_FIELDS = [("ID", "N", 10), ("KATEGORIE", "C", 20), ("VERSION", "C", 10), ("VERSIONERL", "C", 10), ("BESCHREIBU", "C", 40), ("PRODUKTID", "N", 6), ("FEHLER", "M", 10), ("LOESUNG", "M", 10), ("STATUSID", "N", 6), ("BEARBEITET", "D", 8)]


@query(f"""
SELECT 'ticket_' || s_suppkey AS doc_id, coalesce(p.label, (s_nationkey % 40)::VARCHAR) AS product, coalesce(t.label, (s_suppkey % 9)::VARCHAR) AS status, strftime(DATE '2020-01-01' + (s_suppkey % 900)::INTEGER, '%Y-%m-%d') AS processed_date,
       s_name || chr(10) || chr(10) || 'Fehlerbeschreibung:' || chr(10) || 'Saldo ' || s_acctbal::VARCHAR || chr(10) || chr(10) || 'Lösung:' || chr(10) || 'Konto prüfen' AS full_text
FROM supplier LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in lookups.PRODUCTS.items())}) AS p(code, label) ON p.code = (s_nationkey % 40)::VARCHAR
LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in lookups.TICKET_STATES.items())}) AS t(code, label) ON t.code = (s_suppkey % 9)::VARCHAR
WHERE s_suppkey % 5 <> 0
""")
def ticket_table(spark, sf_dir):
    """Suppliers as a dBASE table of four files with memos, written and read by
    tasks; each fifth has no solution."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "string(s_suppkey) AS ID", "'K' AS KATEGORIE", "'1' AS VERSION", "'2' AS VERSIONERL", "s_name AS BESCHREIBU", "string(s_nationkey % 40) AS PRODUKTID", "concat('<b>Saldo</b> ', string(s_acctbal)) AS FEHLER",
        "if(s_suppkey % 5 = 0, '', concat('Konto prüfen', char(10), 'Mit freundlichen Grüssen', char(10), s_name)) AS LOESUNG", "string(s_suppkey % 9) AS STATUSID", "date_format(date_add(date'2020-01-01', int(s_suppkey % 900)), 'yyyyMMdd') AS BEARBEITET",
    )
    dbf.write(rows, _FIELDS, f"{path}/t", f"{path}/memo", parts=4)
    g = prepare.ticket_gold(prepare.ticket_silver(files.tickets_dbf(spark, f"{path}/t", f"{path}/memo")))
    return g.select("doc_id", "metadata.product", "metadata.status", "metadata.processed_date", "content.full_text")


_LINE = STRIP.format("l")
_CLEAN_LINE = f"CASE WHEN regexp_matches({_LINE}, '^\\d+$|(?i)^Copyright\\s+©|(?i)^©\\s*\\d{{4}}|(?i)^Seite\\s+\\d+') THEN '' ELSE {_LINE} END"


@query(rf"""
WITH p AS (SELECT doc_id, source, i, {_CLEAN_LINE} AS t FROM (SELECT doc_id, source, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS l FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)))
SELECT doc_id::VARCHAR AS doc_id, 'file_' || any_value(source) || '.pdf' AS filename, count(*)::INTEGER AS page_count, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> ''), '') AS full_text FROM p GROUP BY doc_id
""")
def paged_documents(spark, sf_dir):
    """Page by page through silver and gold, written and read as JSON lines."""
    path = scratch(spark)
    g = gold(spark, sf_dir, "handbuch").select("doc_id", F.col("metadata.filename").alias("filename"), "content.outline", "content.pages", "images")
    sinks.write_jsonl(prepare.paged_gold(prepare.paged_silver(g), "handbuch"), path)
    return files.gold_jsonl(spark, [path, path + "-none"]).select("doc_id", "metadata.filename", "metadata.page_count", "content.full_text")


_CATEGORIES = "['Chunking', 'Recency', 'Visuals', 'CrossSource']"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as a question set of several files, written and read."""
    path = scratch(spark)
    b = table(spark, sf_dir, "benchmark").select("item_id", F.format_string("Q%03d", F.col("item_id") % 1000).alias("id"), F.col("text").alias("question"), F.get(F.array(*[F.lit(c) for c in files.CATEGORIES]), (F.col("item_id") % 4).cast("int")).alias("category"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("g"), F.col("item_id").cast("string"))).alias("ground_truth"))
    sinks.write_jsonl(b.repartitionByRange(4, "item_id").sortWithinPartitions("item_id").drop("item_id"), path)
    return files.questions_jsonl(spark, path + "/part-*")


@query(f"SELECT row_number() OVER (ORDER BY item_id)::INTEGER AS line_no, 'Q' || lpad((item_id % 1000)::VARCHAR, 3, '0') AS id, text AS question, {_CATEGORIES}[item_id % 4 + 1] AS category, CASE WHEN item_id % 2 = 0 THEN 'g' || item_id ELSE '' END AS ground_truth FROM benchmark")
def question_set(spark, sf_dir):
    return _questions(spark, sf_dir)


def _told(prompts: list[str]) -> list[dict]:
    """Stands in for a model: says how long the prompt is, and fails where
    that ends in 7."""
    return [{"error": f"no answer to {len(p)}"} if len(p) % 10 == 7 else {"answer": f"length {len(p)}", "model": "m", "input_tokens": len(p), "output_tokens": 2, "duration_seconds": 0.5} for p in prompts]


def _asked_and_found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(questions, their hits)."""
    q = _questions(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("forum").alias("source_type"), F.col("source").alias("source_file"), F.lit(0).alias("chunk_index"))
    found = _lexical(spark, sf_dir, 5).withColumn("query_id", F.format_string("Q%03d", F.col("query_id") % 1000))
    return q, retrieve.with_chunks(found, d).withColumn("id", F.col("id").cast("string")).withColumn("similarity", F.lit(0.0))


def _bundle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(questions, the run's bundle as written and read)."""
    path = scratch(spark)
    q, hits = _asked_and_found(spark, sf_dir)
    sinks.write_jsonl(evaluate.run_testset(q, hits, _told, "v2", "t"), path)
    return q, files.bundle_jsonl(spark, path)


_RUN = f"""{_BM25.format(k=5)},
ctx AS (SELECT query_id, count(*) AS n_hits, string_agg('[source_file: ' || source || ', chunk_index: 0]' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS ctx FROM lex JOIN documents ON doc_id = id GROUP BY query_id),
asked AS (SELECT 'Q' || lpad((item_id % 1000)::VARCHAR, 3, '0') AS question_id, item_id, text, {_CATEGORIES}[item_id % 4 + 1] AS category, coalesce(n_hits, 0) AS n_hits, length('Kontext:') + 2 + length(coalesce(ctx, '')) + 2 + length('Frage: ') + length(text) AS n
          FROM benchmark LEFT JOIN ctx ON query_id = item_id)"""


@query(f"WITH {_RUN} SELECT question_id, category, CASE WHEN n % 10 <> 7 THEN 'length ' || n END AS answer, CASE WHEN n % 10 <> 7 THEN n_hits::INTEGER END AS n_hits, CASE WHEN n % 10 = 7 THEN 'no answer to ' || n END AS error FROM asked")
def run_bundle(spark, sf_dir):
    """A whole run: questions, retrieval, prompts, answers, bundle."""
    _, b = _bundle(spark, sf_dir)
    return b.select("question_id", "category", "result.answer", F.when(F.col("error").isNull(), F.size("result.retrieved_chunks")).alias("n_hits"), "error")


@query(f"WITH {_RUN} SELECT question_id, category, CASE WHEN n % 10 <> 7 THEN 'length ' || n END AS answer, CASE WHEN n % 10 = 7 THEN 'no answer to ' || n END AS error FROM asked")
def run_resumed(spark, sf_dir):
    """A run in batches that is killed in its second one, and goes on."""
    path = scratch(spark)
    q, hits = _asked_and_found(spark, sf_dir)
    q, hits, tries = written(q), written(hits), []

    def run(own):
        tries.append(1)
        if len(tries) == 2:
            raise InterruptedError
        return evaluate.run_testset(own, hits, _told, "v2", "t")

    try:
        evaluate.run_in_batches(q, run, path, size=16)
    except InterruptedError:
        evaluate.run_in_batches(q, run, path, size=16)
    return files.bundle_jsonl(spark, path).select("question_id", "category", "result.answer", "error")


def _judge(rows: list[str]) -> list[dict]:
    import json

    parsed = [json.loads(r) for r in rows]
    return [{"faithfulness": len(r["retrieved_contexts"]) / 5, "context_recall": float("nan"), "factual_correctness": float(len(r["reference"]))} for r in parsed]


@query(f"WITH {_RUN} SELECT question_id, category, n_hits / 5.0::DOUBLE AS faithfulness, NULL::DOUBLE AS answer_relevance, NULL::DOUBLE AS context_recall, (CASE WHEN item_id % 2 = 0 THEN length('g' || item_id) ELSE 0 END)::DOUBLE AS factual_correctness FROM asked WHERE n % 10 <> 7")
def run_scores(spark, sf_dir):
    """The run's answers judged; scores written and read again."""
    path = scratch(spark)
    q, b = _bundle(spark, sf_dir)
    sinks.write_scores(evaluate.score_bundle(b, q, _judge), path, judge="stand-in")
    return files.scores_json(spark, path).select("question_id", "category", *METRICS)


@query(f"WITH {_SCORES} SELECT question_id::VARCHAR AS question_id, category, {', '.join(METRICS)} FROM s WHERE variant = 'V1'")
def score_file(spark, sf_dir):
    path = scratch(spark)
    sinks.write_scores(scores(spark, sf_dir).where("variant = 'V1'").select(F.col("question_id").cast("string").alias("question_id"), "category", *METRICS), path)
    return files.scores_json(spark, path).drop("file")


@query(f"WITH {_BM25.format(k=5)} SELECT query_id, id, bm25, rank::INTEGER AS rank FROM lex")
def bm25_persisted(spark, sf_dir):
    """The lexical index as bucketed catalog tables, read back and searched."""
    return retrieve.bm25_search(_asked(spark, sf_dir), _index(spark, sf_dir, buckets=8), 5, 6)


@query("SELECT doc_id, 'src' || doc_id % 3 AS source_type, n_chars FROM documents")
def vector_table(spark, sf_dir):
    """Rows written to the index in two parts, after a first that is reset."""
    path = scratch(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")).alias("source_type"), "n_chars")
    sinks.write_index(d, path)
    sinks.write_index(d.where("doc_id % 2 = 0"), path, reset=True)
    sinks.write_index(d.where("doc_id % 2 = 1"), path)
    sinks.backup_once(spark.read.parquet(path), f"{path}-copy")
    sinks.backup_once(d.limit(0), f"{path}-copy")
    return spark.read.parquet(f"{path}-copy").select("doc_id", "source_type", "n_chars")


@query("SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents")
def silver_table(spark, sf_dir):
    """As CSV without its nested column, and back."""
    path = scratch(spark)
    sinks.write_silver_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.array("source").alias("tags")), path)
    return files.tickets_csv(spark, path)


@query("SELECT 'img_' || doc_id AS image_id, doc_id::INTEGER AS page, (doc_id % 700)::INTEGER AS width, 100::INTEGER AS height, CASE WHEN doc_id % 10 = 0 THEN 'neu' ELSE 'Bild ' || length('url' || doc_id) END AS vlm_description FROM documents WHERE doc_id % 700 >= 300 OR doc_id % 10 = 0")
def image_descriptions(spark, sf_dir):
    """Large images described where the cache lacks them; the cache is written
    before and added to, and read with the last line of an image."""
    path = scratch(spark)
    d = table(spark, sf_dir, "documents").select(F.format_string("img_%d", "doc_id").alias("image_id"), F.col("doc_id").cast("int").alias("page"), (F.col("doc_id") % 700).cast("int").alias("width"), F.lit(100).alias("height"), F.concat(F.lit("url"), F.col("doc_id").cast("string")).alias("url"))
    known = d.where("page % 10 = 0").select("image_id", "page", "width", "height")
    for text in ("alt", "neu"):
        sinks.append_cache(known.withColumn("vlm_description", F.lit(text)), path)
    sinks.append_cache(enrich.describe_images(d, files.image_cache(spark, path), lambda urls: [f"Bild {len(u)}" for u in urls]), path)
    return files.image_cache(spark, path).select("image_id", "page", "width", "height", "vlm_description")


@query("""
SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'third' WHEN doc_id % 50 <> 7 THEN 'second ' || repeat('x', (doc_id % 40)::INTEGER) ELSE 'first' END AS keywords
FROM documents WHERE doc_id % 50 = 7 OR doc_id % 3 = 0 OR doc_id % 2 = 0
""")
def cache_appends(spark, sf_dir):
    """One log, appended to three times, the smallest first: of an entry that
    several have, the last one's counts; then compacted, and read again."""
    path = scratch(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("n"))
    entry = lambda df, text: df.select("chunk_id", F.array(text).alias("keywords"))
    sinks.append_cache(entry(d.where("n % 50 = 7"), F.lit("first")).coalesce(1), path)
    sinks.append_cache(entry(d.where("n % 2 = 0 AND n % 50 <> 7"), F.concat(F.lit("second "), F.repeat(F.lit("x"), (F.col("n") % 40).cast("int")))), path)
    sinks.append_cache(entry(d.where("n % 3 = 0").repartition(3), F.lit("third")), path)
    sinks.compact_cache(files.keyword_cache(spark, path), path)
    return files.keyword_cache(spark, path).select("chunk_id", F.array_join("keywords", ",").alias("keywords"))
