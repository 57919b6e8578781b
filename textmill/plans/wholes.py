"""Queries over whole chains: every source's metadata, the illustrated
chunker, answers, the table of means and changes, counters of changed texts."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import chunk, enrich, evaluate, prepare, retrieve
from textmill.plans.corpus import _OUTLINE, _PAGED, CLEAN, STRIP, TOKENS, gold, posts
from textmill.plans.details import _TICKETS, _tickets
from textmill.plans.registry import ORACLES, query, table
from textmill.plans.search import _BM25, _MEANS, _PAIRS, _SCORES, _asked, _lexical, scores
from textmill.schemas import METRICS


@query(f"""
WITH {_TICKETS}, g AS (SELECT id, product, role || chr(10) || chr(10) || 'Fehlerbeschreibung:' || chr(10) || chr(10) || chr(10) || 'Lösung:' || chr(10) || solution AS text FROM t WHERE solution <> ''),
k AS (SELECT *, {TOKENS.format("text")} AS t FROM g)
SELECT 'ticket__ticket_' || id || CASE WHEN len(t) <= 8000 THEN '' ELSE '_overflow_recursive_' || lpad(i::VARCHAR, 4, '0') END AS id, id AS ticket_id, product, '' AS category, '' AS version_reported, '' AS version_resolved, '2024-05-06' AS processed_date,
       CASE WHEN len(t) <= 8000 THEN text ELSE array_to_string(list_slice(t, i * 1400 + 1, i * 1400 + 1500), '') END AS text
FROM (SELECT *, unnest(range(CASE WHEN len(t) <= 8000 THEN 1 ELSE 1 + ceil((len(t) - 1500) / 1400.0)::BIGINT END)) AS i FROM k)
""")
def ticket_chunks(spark, sf_dir):
    """Tickets from silver to chunks with all their metadata."""
    g = prepare.ticket_gold(_tickets(spark, sf_dir))
    return enrich.with_metadata(chunk.v1(g), g).select("id", "ticket_id", "product", "category", "version_reported", "version_resolved", "processed_date", "text")


@query(f"""
WITH {_OUTLINE}, c AS ({ORACLES["outline_chunks"]}),
p AS (SELECT id, path, regexp_extract(id, '^handbuch__([0-9]+)_', 1)::BIGINT AS doc_id, string_split(path, ' > ') AS parts FROM c),
e AS (SELECT p.id, o.doc_id, o.i, o.page, o.n, o.level FROM p JOIN o ON o.doc_id = p.doc_id AND o.title = p.parts[-1] AND o.level = len(p.parts)),
f AS (SELECT e.id, min_by(x.page, x.i) AS page_end FROM e JOIN o x ON x.doc_id = e.doc_id AND x.i > e.i AND x.level <= e.level GROUP BY e.id)
SELECT p.id, coalesce(p.path, '') AS outline_path, coalesce(len(p.parts), 0)::INTEGER AS outline_level, coalesce(e.page, 0)::INTEGER AS page_start, coalesce(f.page_end, e.n + 1, 0)::INTEGER AS page_end, 'file ' || d.source AS doc_title
FROM p JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN e ON e.id = p.id LEFT JOIN f ON f.id = p.id
""")
def manual_chunks(spark, sf_dir):
    """Manuals cut by their outline, with the section's level, pages and title."""
    g = gold(spark, sf_dir, "handbuch")
    return enrich.with_metadata(chunk.v1(g), g).select("id", "outline_path", "outline_level", "page_start", "page_end", "doc_title")


@query(rf"""
WITH {_PAGED},
plain AS (SELECT 'schulungsunterlage__' || doc_id || '_page_' || lpad(page::VARCHAR, 4, '0') || CASE WHEN cut THEN '_recursive_' || lpad(n::BIGINT::VARCHAR, 4, '0') ELSE '' END AS id, n::INTEGER AS chunk_index, CASE WHEN cut THEN 'recursive_fallback' ELSE 'page' END AS chunking_strategy, page, source, text FROM chunks WHERE source <> 'src1'),
m AS (SELECT doc_id, source, page, array_to_string(list_filter([{STRIP.format("line")}, CASE WHEN page % 2 = 0 AND page <= 40 THEN '[Bild: Bild ' || page || ']' ELSE '' END], lambda x: x <> ''), chr(10) || chr(10)) AS text FROM l WHERE source = 'src1'),
pictured AS (SELECT 'schulungsunterlage__' || doc_id || '_page_' || lpad(page::VARCHAR, 4, '0') AS id, (page - 1)::INTEGER AS chunk_index, 'page_v4' AS chunking_strategy, page, source, text FROM m WHERE text <> '')
SELECT id, chunk_index, chunking_strategy, page::INTEGER AS page_number, 'file ' || source AS doc_title, 'Seite,nummer,' || page || 'te' AS keywords, text FROM (SELECT * FROM plain UNION ALL SELECT * FROM pictured)
""")
def chunks_v4(spark, sf_dir):
    """The v4 chunker by its name: one file page by page with descriptions of
    its images, the others as in v2, all with cached keywords."""
    g = gold(spark, sf_dir, "schulungsunterlage")
    pages = g.where("metadata.filename = 'file_src1.pdf'").select("source_type", "doc_id", F.explode("content.pages").alias("p")).select("source_type", "doc_id", "p.page_number", "p.text")
    blocks = pages.select("*", F.lit(0).alias("pos"), F.lit(10.0).alias("y"))
    images = pages.where("page_number % 2 = 0").select("source_type", "doc_id", "page_number", F.lit(1).alias("index"), F.lit(50.0).alias("y"))
    said = spark.range(1, 41).select(F.format_string("schulung_auftrag_einsteiger_p%03d_img01", "id").alias("image_id"), F.format_string("Bild %d", "id").alias("vlm_description"))
    needs = {"merged": chunk.merge_images(blocks, images, said), "filename": "file_src1.pdf"}
    known = spark.createDataFrame([], "chunk_id string, keywords array<string>")
    words = F.array(F.lit("Seite"), F.lit("nummer"), F.concat(F.col("page_number").cast("string"), F.lit("te")))
    cache = enrich.v4(g, known, **needs, gate=False).select(F.col("id").alias("chunk_id"), words.alias("keywords"))
    return enrich.chunker("v4", cache=cache, **needs)(g).select("id", "chunk_index", "chunking_strategy", "page_number", "doc_title", "keywords", "text")


def _short(prompts: list[str]) -> list[str]:
    """Stands in for a model: says how long the prompt is."""
    return [f"length {len(p)}" for p in prompts]


@query(f"""WITH {_BM25.format(k=5)},
c AS (SELECT query_id, count(*) AS n, string_agg('[source_file: ' || source || ', chunk_index: 0]' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS ctx, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM lex JOIN documents ON doc_id = id GROUP BY query_id)
SELECT item_id AS query_id, text AS query, 'length ' || (length('Kontext:') + 2 + length(coalesce(ctx, '')) + 2 + length('Frage: ') + length(text)) AS answer, coalesce(n, 0)::INTEGER AS n_chunks, coalesce(ids, '') AS chunk_ids FROM benchmark LEFT JOIN c ON query_id = item_id""")
def answers(spark, sf_dir):
    """Retrieval, prompt, answer and the chunks it rests on, for every query."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_file"), F.lit(0).alias("chunk_index"))
    a = retrieve.answer(_asked(spark, sf_dir), retrieve.with_chunks(_lexical(spark, sf_dir, 5), d), _short)
    ids = F.transform("retrieved_chunks", lambda c: c["id"].cast("string"))
    return a.select("query_id", "query", "answer", F.coalesce(F.size("retrieved_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.array_join(ids, ","), F.lit("")).alias("chunk_ids"))


@query(f"""WITH {_SCORES}, m AS (SELECT variant, {_MEANS} FROM s GROUP BY variant)
SELECT 'mean' AS kind, variant AS label, {", ".join(METRICS)} FROM m
UNION ALL SELECT 'delta', target || ' - ' || base, {", ".join(f"round(t.{m} - b.{m}, 4)" for m in METRICS)} FROM {_PAIRS} JOIN m b ON b.variant = base JOIN m t ON t.variant = target""")
def means_and_deltas(spark, sf_dir):
    return evaluate.means_and_deltas(scores(spark, sf_dir))


_STRIPPED = r"regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g')"


@query(rf"""SELECT count(*) FILTER ({_STRIPPED} <> coalesce(text, '')) AS html, count(*) FILTER (regexp_replace(coalesce(text, ''), '\[/?[a-zA-Z][^\]]*\]', '', 'g') <> coalesce(text, '')) AS bbcode, count(*) FILTER ({CLEAN} <> coalesce(text, '')) AS changed FROM documents""")
def change_counts(spark, sf_dir):
    """In how many posts each cleaning step changed the text, counted as they
    pass through the step that writes them."""
    seen = Observation()
    prepare.forum_silver(posts(spark, sf_dir), seen).write.format("noop").mode("overwrite").save()
    n = seen.get
    return spark.range(1).select(*[F.lit(n[k]).cast("long").alias(name) for k, name in (("html", "html"), ("bbcode", "bbcode"), ("any", "changed"))])


@query("SELECT 'Q' || lpad((item_id % 1000)::VARCHAR, 3, '0') AS id, pos::INTEGER AS pos, text AS question FROM benchmark JOIN (VALUES (0, 'Q007'), (1, 'Q003'), (2, 'Q999'), (3, 'Q011')) AS w(pos, id) ON w.id = 'Q' || lpad((item_id % 1000)::VARCHAR, 3, '0')")
def dry_run_ids(spark, sf_dir):
    """A dry run of given questions, in the order given; unknown ones are left out."""
    q = table(spark, sf_dir, "benchmark").select(F.format_string("Q%03d", F.col("item_id") % 1000).alias("id"), F.col("text").alias("question"))
    return evaluate.dry_run(q, ["Q007", "Q003", "Q999", "Q011"]).select("id", "pos", "question")


@query(rf"""
WITH t AS (SELECT doc_id, {TOKENS.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, t, unnest(range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 1000 THEN 1 ELSE 1 + ceil((len(t) - 1000) / 850.0)::BIGINT END)) AS i FROM t)
SELECT 'web__' || doc_id || '_chunk_' || lpad(i::VARCHAR, 4, '0') AS id, i::INTEGER AS chunk_index, array_to_string(list_slice(t, i * 850 + 1, i * 850 + 1000), '') AS text FROM w ORDER BY doc_id::VARCHAR, i LIMIT 100
""")
def first_chunks(spark, sf_dir):
    """The first chunks in order of document, for a trial index."""
    return chunk.limited(chunk.v0(gold(spark, sf_dir, "web")), 100).select("id", "chunk_index", "text")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def page_normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_page(F.col("text")).alias("text"))
