"""Queries on cleaning, chunking, enrichment and profiles.

The driver's tables stand in for the sources: documents for posts and manuals
(their lines are the pages), conversations for tickets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import lookups
from textmill.functions import text as X
from textmill.functions.providers import frequent_words
from textmill.operators import chunk, enrich, prepare, profile
from textmill.plans.registry import query, table
from textmill.schemas import GOLD
from textmill.streaming import ingest

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TOKENS = r"regexp_extract_all({}, '(?:^\s+)?\S+\s*')"
CLEAN = STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), '\[/?[a-zA-Z][^\]]*\]', '', 'g'), '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g')")
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("post_id"), F.lit("1").alias("topic_id"), (F.col("doc_id") % 90).cast("string").alias("forum_id"), (F.col("doc_id") * 86400).alias("post_time"), F.col("source").alias("post_subject"), F.col("text").alias("post_text"), F.col("doc_id").alias("src_pos"))


def gold(spark: SparkSession, sf_dir: str, source_type: str) -> DataFrame:
    """Documents as gold rows: the lines of a text are its pages; every line
    has an outline entry, of levels 1, 2, 3, 2, 3, 3 in turn."""
    lines = F.split("text", "\n")
    level = lambda i: F.get(F.array(*[F.lit(x) for x in (1, 2, 3, 2, 3, 3)]), (i % 6).cast("int"))
    d = table(spark, sf_dir, "documents").withColumn("lines", lines)
    return d.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit(source_type).alias("source_type"),
        F.struct(*[(F.concat(F.lit("file_"), F.col("source"), F.lit(".pdf")) if f.name == "filename" else F.lit(None)).cast(f.dataType).alias(f.name) for f in GOLD["metadata"].dataType]).alias("metadata"),
        F.struct(
            F.col("text").alias("full_text"),
            F.transform("lines", lambda t, i: F.struct(level(i).alias("level"), F.concat(F.lit("t"), i.cast("string")).alias("title"), (i + 1).alias("page"))).alias("outline"),
            F.transform("lines", lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("text"))).alias("pages"),
        ).alias("content"),
        F.lit(None).cast(GOLD["images"].dataType).alias("images"),
    )


@query(f"""
SELECT doc_id::VARCHAR AS post_id, post_text, post_date, module FROM (
  SELECT doc_id, t AS post_text, strftime(DATE '1970-01-01' + doc_id::INTEGER, '%Y-%m-%d') AS post_date, coalesce(label, (doc_id % 90)::VARCHAR) AS module,
         row_number() OVER (PARTITION BY t ORDER BY doc_id) AS n
  FROM (SELECT doc_id, {CLEAN} AS t FROM documents) LEFT JOIN (VALUES {", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in lookups.FORUM_MODULES.items())}) AS l(code, label) ON code = (doc_id % 90)::VARCHAR
  WHERE t <> '') WHERE n = 1
""")
def forum_silver(spark, sf_dir):
    return prepare.forum_silver(posts(spark, sf_dir)).select("post_id", "post_text", "post_date", "module")


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages
""")
def markup_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.clean_ticket(F.col("html"), entities=False).alias("text"))


@query()
def markup_unescaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.clean_markup(F.col("html")).alias("text"))


@query(rf"""
SELECT doc_id, {STRIP.format("array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(" + STRIP.format("l") + r", '^\d+$|(?i)^Copyright\s+©|(?i)^©\s*\d{4}|(?i)^Seite\s+\d+')), chr(10))")} AS text FROM documents
""")
def boilerplate_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.remove_boilerplate(F.col("text")).alias("text"))


@query(rf"""
SELECT conv_id, turn, {STRIP.format("regexp_replace(text, '(?is)\\n--\\s*\\n.*$|\\nMit freundlichen Gr[uü]ssen.*$|\\nMit freundlichen Gr[uü]ßen.*$|\\nBest regards.*$|\\nKind regards.*$|\\nFreundliche Gr[uü]sse.*$', '')").replace(chr(92) * 2, chr(92))} AS text FROM conversations
""")
def signature_strip(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.remove_signature(F.col("text")).alias("text"))


@query(f"""
SELECT doc_id, (doc_id % 40)::VARCHAR AS code, coalesce(label, (doc_id % 40)::VARCHAR) AS product
FROM documents LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in lookups.PRODUCTS.items())}) AS p(code, label) ON p.code = (doc_id % 40)::VARCHAR
""")
def doc_lookup_default(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).cast("string").alias("code"))
    return lookups.resolve(d, "code", "product", lookups.PRODUCTS)


@query(rf"""
SELECT 'web__' || doc_id || '_chunk_' || lpad(i::VARCHAR, 4, '0') AS id, i::INTEGER AS chunk_index, array_to_string(list_slice(t, i * 850 + 1, i * 850 + 1000), '') AS text
FROM (SELECT doc_id, t, unnest(range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 1000 THEN 1 ELSE 1 + ceil((len(t) - 1000) / 850.0)::BIGINT END)) AS i
      FROM (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents))
""")
def v0_chunks(spark, sf_dir):
    return chunk.v0(gold(spark, sf_dir, "web")).select("id", "chunk_index", "text")


@query(rf"""
SELECT 'forum__' || doc_id || CASE WHEN n <= 8000 THEN '' ELSE '_overflow_recursive_' || lpad(i::VARCHAR, 4, '0') END AS id, i::INTEGER AS chunk_index,
       CASE WHEN n <= 8000 THEN 'atomic' ELSE 'recursive_fallback' END AS chunking_strategy, CASE WHEN n <= 8000 THEN text ELSE array_to_string(list_slice(t, i * 1400 + 1, i * 1400 + 1500), '') END AS text
FROM (SELECT doc_id, text, t, len(t) AS n, unnest(range(CASE WHEN len(t) <= 8000 THEN 1 ELSE 1 + ceil((len(t) - 1500) / 1400.0)::BIGINT END)) AS i
      FROM (SELECT doc_id, text, {TOKENS.format("text")} AS t FROM documents))
""")
def atomic_chunks(spark, sf_dir):
    return chunk.atomic(gold(spark, sf_dir, "forum")).select("id", "chunk_index", "chunking_strategy", "text")


@query(rf"""
WITH p AS (SELECT doc_id, i, {STRIP.format("lines[i]")} AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
t AS (SELECT doc_id, i, text, {TOKENS.format("text")} AS t FROM p WHERE text <> ''),
w AS (SELECT *, CASE WHEN len(t) <= 2000 THEN 1 ELSE 1 + ceil((len(t) - 1500) / 1400.0)::BIGINT END AS k FROM t),
s AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM w),
e AS (SELECT *, unnest(range(k)) AS j FROM s)
SELECT 'modulbeschreibung__' || doc_id || '_page_' || lpad(i::VARCHAR, 4, '0') || CASE WHEN len(t) <= 2000 THEN '' ELSE '_recursive_' || lpad((start + j)::VARCHAR, 4, '0') END AS id,
       (start + j)::INTEGER AS chunk_index, i::INTEGER AS page_number, CASE WHEN len(t) <= 2000 THEN text ELSE array_to_string(list_slice(t, j * 1400 + 1, j * 1400 + 1500), '') END AS text FROM e
""")
def page_chunks(spark, sf_dir):
    return chunk.by_page(gold(spark, sf_dir, "modulbeschreibung")).select("id", "chunk_index", "page_number", "text")


_OUTLINE = """o AS (SELECT doc_id, n, i, 't' || i AS title, i + 1 AS page, [1, 2, 3, 2, 3, 3][i % 6 + 1] AS level FROM (SELECT doc_id, n, unnest(range(n)) AS i FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)))"""


@query(f"""
WITH {_OUTLINE},
w AS (SELECT *, coalesce(last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS h1,
      coalesce(first_value(CASE WHEN level <= 2 THEN page END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n + 1) AS last FROM o)
SELECT doc_id::VARCHAR AS doc_id, h1, title, page::INTEGER AS start_page, last::INTEGER AS end_page FROM w WHERE level = 2
""")
def outline_sections(spark, sf_dir):
    g = gold(spark, sf_dir, "handbuch").select("doc_id", F.col("content.outline").alias("outline"), F.col("content.pages").alias("pages"))
    return chunk.sections(g).select("doc_id", "h1", "title", F.col("start").alias("start_page"), F.col("end").alias("end_page"))


@query(rf"""
WITH {_OUTLINE},
w AS (SELECT *, coalesce(last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS h1,
      coalesce(first_value(CASE WHEN level <= 2 THEN page END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n + 1) AS last FROM o),
pg AS (SELECT doc_id, i + 1 AS page, {STRIP.format("l[i + 1]")} AS text FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
h2 AS (SELECT w.doc_id, w.i, any_value(w.h1) AS h1, any_value(w.title) AS title, any_value(w.page) AS page, any_value(w.last) AS last, string_agg(pg.text, chr(10) ORDER BY pg.page) AS text
       FROM w JOIN pg ON pg.doc_id = w.doc_id AND pg.page >= w.page AND pg.page < w.last AND pg.text <> '' WHERE w.level = 2 GROUP BY w.doc_id, w.i),
h2n AS (SELECT *, len({TOKENS.format("text")}) AS nt, EXISTS (SELECT 1 FROM o WHERE o.doc_id = h2.doc_id AND o.level = 3 AND o.page >= h2.page AND o.page < h2.last) AS has3 FROM h2),
h3 AS (SELECT h2n.doc_id, h2n.i, o.i AS i3, h2n.h1, h2n.title, o.title AS t3, o.page, coalesce(lead(o.page) OVER (PARTITION BY h2n.doc_id, h2n.i ORDER BY o.i), h2n.last) AS last
       FROM h2n JOIN o ON o.doc_id = h2n.doc_id AND o.level = 3 AND o.page >= h2n.page AND o.page < h2n.last WHERE nt > 2000),
h3t AS (SELECT h3.doc_id, h3.i, h3.i3, any_value(h1) AS h1, any_value(title) AS title, any_value(t3) AS t3, string_agg(pg.text, chr(10) ORDER BY pg.page) AS text
        FROM h3 JOIN pg ON pg.doc_id = h3.doc_id AND pg.page >= h3.page AND pg.page < h3.last AND pg.text <> '' GROUP BY h3.doc_id, h3.i, h3.i3),
pc AS (SELECT doc_id, i, 0 AS i3, 'h2' AS kind, h1 || ' > ' || title AS path, text FROM h2n WHERE nt <= 2000 OR NOT has3
       UNION ALL SELECT doc_id, i, i3, 'h3', h1 || ' > ' || title || ' > ' || t3, text FROM h3t),
t AS (SELECT *, {TOKENS.format("text")} AS t FROM pc),
k AS (SELECT *, CASE WHEN len(t) <= 2000 THEN 1 ELSE 1 + ceil((len(t) - 1500) / 1400.0)::BIGINT END AS k FROM t),
s AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY doc_id ORDER BY i, i3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k),
e AS (SELECT *, unnest(range(k)) AS j FROM s),
fl AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = documents.doc_id AND o.level = 2)),
fe AS (SELECT *, unnest(range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 1500 THEN 1 ELSE 1 + ceil((len(t) - 1500) / 1400.0)::BIGINT END)) AS j FROM fl)
SELECT 'handbuch__' || doc_id || '_' || kind || '_' || lpad(start::VARCHAR, 4, '0') || CASE WHEN len(t) <= 2000 THEN '' ELSE '_recursive_' || lpad((start + j)::VARCHAR, 4, '0') END AS id,
       (start + j)::INTEGER AS chunk_index, path, CASE WHEN len(t) <= 2000 THEN text ELSE array_to_string(list_slice(t, j * 1400 + 1, j * 1400 + 1500), '') END AS text FROM e
UNION ALL SELECT 'handbuch__' || doc_id || '_nooutline_recursive_' || lpad(j::VARCHAR, 4, '0'), j::INTEGER, NULL, array_to_string(list_slice(t, j * 1400 + 1, j * 1400 + 1500), '') FROM fe
""")
def outline_chunks(spark, sf_dir):
    return chunk.by_outline(gold(spark, sf_dir, "handbuch")).select("id", "chunk_index", F.array_join("outline_path", " > ").alias("path"), "text")


@query(rf"""
WITH c AS (SELECT 'forum' AS source_type, CASE WHEN len({TOKENS.format("text")}) <= 8000 THEN 1 ELSE 1 + ceil((len({TOKENS.format("text")}) - 1500) / 1400.0)::BIGINT END AS k, len({TOKENS.format("text")}) <= 8000 AS whole FROM documents)
SELECT source_type, CASE WHEN whole THEN 'atomic' ELSE 'recursive_fallback' END AS chunking_strategy, sum(k)::BIGINT AS n_chunks FROM c GROUP BY ALL
""")
def chunk_strategy_counts(spark, sf_dir):
    return chunk.strategy_counts(chunk.v1(gold(spark, sf_dir, "forum")))


@query(f"""
WITH {_OUTLINE},
e AS (SELECT doc_id, i, title, page, level, coalesce((SELECT min_by(x.page, x.i) FROM o x WHERE x.doc_id = o.doc_id AND x.i > o.i AND x.level <= o.level), n + 1) AS last FROM o WHERE level = 2)
SELECT doc_id::VARCHAR AS doc_id, title, page::INTEGER AS page_start, last::INTEGER AS page_end FROM e
""")
def section_page_lookup(spark, sf_dir):
    g = gold(spark, sf_dir, "handbuch").select("doc_id", F.col("content.outline").alias("outline"), F.col("content.pages").alias("pages"))
    s = chunk.sections(g).join(g.select("doc_id", "outline"), "doc_id")
    s = s.select("doc_id", "title", enrich.section_pages(F.col("outline"), F.array("h1", "title")).alias("s"))
    return s.select("doc_id", "title", F.col("s.start").alias("page_start"), F.col("s.end").alias("page_end"))


#: Pages of documents as chunks of their source: within the limit whole, else
#: in windows; n counts the chunks of the document before the page.
_PAGED = rf"""
l AS (SELECT doc_id, source, unnest(range(1, len(l) + 1)) AS page, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
t AS (SELECT doc_id, source, page, {TOKENS.format(STRIP.format("line"))} AS t, {STRIP.format("line")} AS text FROM l WHERE {STRIP.format("line")} <> ''),
c AS (SELECT *, len(t) > 2000 AS cut, CASE WHEN len(t) <= 2000 THEN 1 ELSE 1 + ceil((len(t) - 1500) / 1400.0)::BIGINT END AS parts FROM t),
s AS (SELECT *, coalesce(sum(parts) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
chunks AS (SELECT doc_id, source, cut, page, start + i AS n, CASE WHEN cut THEN array_to_string(list_slice(t, i * 1400 + 1, i * 1400 + 1500), '') ELSE text END AS text FROM (SELECT *, unnest(range(parts)) AS i FROM s))
"""


@query(rf"""
WITH {_PAGED}
SELECT 'schulungsunterlage__' || doc_id || '_page_' || lpad(page::VARCHAR, 4, '0') || CASE WHEN cut THEN '_recursive_' || lpad(n::BIGINT::VARCHAR, 4, '0') ELSE '' END AS id, 'file ' || source AS doc_title, '' AS module_filename FROM chunks
""")
def chunk_metadata(spark, sf_dir):
    g = gold(spark, sf_dir, "schulungsunterlage")
    return enrich.with_metadata(chunk.v1(g), g).select("id", "doc_title", "module_filename")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def keyword_cache_miss(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id"))
    return enrich.cache_misses(d, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "chunk_id")).select("doc_id")


@query(rf"""
SELECT count(*) AS n_chunks, count(*) FILTER (k < 3) AS n_few, avg((k < 3)::INTEGER::DOUBLE) AS few_rate, avg((k < 3)::INTEGER::DOUBLE) <= 0.05 AS ok
FROM (SELECT len(list_filter(list_distinct({WORDS}), lambda w: length(w) BETWEEN 2 AND 60)) AS k FROM documents)
""")
def keyword_quality_gate(spark, sf_dir):
    ks = X.valid_keywords(F.array_distinct(X.split_words(F.col("text"))))
    return enrich.few_keyword_rate(table(spark, sf_dir, "documents").select(ks.alias("keyword_list")))


#: The stand-in provider's eight most frequent words of four letters and more
#: among a text's first 2,000 tokens, as a list.
KEYWORDS = rf"""
kw AS (SELECT doc_id, count(*) AS n, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(array_to_string(list_slice({TOKENS.format("coalesce(text, '')")}, 1, 2000), '')), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents) WHERE length(w) >= 4 GROUP BY doc_id, w),
best AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM kw QUALIFY r <= 8),
keyed AS (SELECT d.doc_id, list_filter(coalesce(k, []), lambda w: length(w) BETWEEN 2 AND 60) AS k FROM documents d LEFT JOIN (SELECT doc_id, list(w ORDER BY r) AS k FROM best GROUP BY doc_id) b ON b.doc_id = d.doc_id)
"""


def made_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    none = spark.createDataFrame([], "chunk_id string, keywords array<string>")
    return enrich.new_keywords(c, none, frequent_words())


@query(f"WITH {KEYWORDS} SELECT doc_id::VARCHAR AS chunk_id, array_to_string(k, ',') AS keywords FROM keyed")
def keywords_offline(spark, sf_dir):
    return made_keywords(spark, sf_dir).select("chunk_id", X.joined_keywords(F.col("keywords")).alias("keywords"))


@query(rf"""
WITH t AS (SELECT {STRIP.format("text")} AS k FROM documents), g AS (SELECT count(*) AS n FROM t WHERE k <> '' GROUP BY k HAVING count(*) >= 2)
SELECT coalesce(sum(n), 0)::BIGINT AS n_rows, count(*) AS n_groups FROM g
""")
def dup_counts(spark, sf_dir):
    return profile.duplicates(table(spark, sf_dir, "documents"), "text")


@query(rf"""
WITH g AS (SELECT count(*) AS n FROM (SELECT {WORDS} AS w FROM documents) WHERE len(w) >= 4 GROUP BY lower(array_to_string(w[1:12], ' ')) HAVING count(*) >= 2)
SELECT coalesce(sum(n), 0)::BIGINT AS n_rows, count(*) AS n_groups FROM g
""")
def near_dup_prefix(spark, sf_dir):
    return profile.similar_starts(table(spark, sf_dir, "documents"), "text")


@query("SELECT count(*) - count(DISTINCT doc_id) AS ids, count(*) - count(DISTINCT text) AS texts, count(*) - count(DISTINCT (lang, source)) AS pairs FROM documents")
def distinct_gaps(spark, sf_dir):
    return profile.distinct_gaps(table(spark, sf_dir, "documents"), {"ids": ["doc_id"], "texts": ["text"], "pairs": ["lang", "source"]})


@query(rf"""
SELECT lang, count(*) AS n, avg(w) AS mean, median(w)::DOUBLE AS median, min(w)::INTEGER AS least, max(w)::INTEGER AS most, count(*) FILTER (w < 30) AS short, count(*) FILTER (w BETWEEN 30 AND 100) AS medium, count(*) FILTER (w > 100) AS long
FROM (SELECT lang, len({WORDS}) AS w FROM documents) WHERE w > 0 GROUP BY lang
""")
def length_profile(spark, sf_dir):
    return profile.lengths(table(spark, sf_dir, "documents"), "text", ["lang"])


@query("SELECT lang AS value, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 1) AS share FROM documents GROUP BY lang")
def freq_table(spark, sf_dir):
    return profile.frequencies(table(spark, sf_dir, "documents"), F.col("lang"))


@query(r"SELECT count(*) AS n_rows, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '\S')) AS text_blank, count(*) FILTER (NOT regexp_matches(coalesce(lang, ''), '\S')) AS lang_blank FROM documents")
def completeness(spark, sf_dir):
    return profile.completeness(table(spark, sf_dir, "documents"), ["text", "lang"])


@query(r"""SELECT count(*) AS n_rows, count(*) FILTER (regexp_matches(text, '�|â€|Ã\S')) AS n_mojibake,
count(*) FILTER (length(regexp_replace(regexp_replace(source, '(?i)^(re\s*:\s*)+', ''), '^\s+|\s+$', '', 'g')) < 3) AS n_uninformative FROM documents""")
def text_faults(spark, sf_dir):
    return profile.text_faults(table(spark, sf_dir, "documents"), "text", "source")


_PAGES = rf"""p AS (SELECT source, doc_id, l[i] AS text, i % 3 AS n_images, len(list_filter(string_split_regex(l[i], '\s+'), lambda w: w <> '')) AS w
  FROM (SELECT source, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents))),
d AS (SELECT source, doc_id, count(*) AS n_pages, count(*) FILTER (w > 0) AS text_pages, count(*) FILTER (n_images > 0) AS image_pages, count(*) FILTER (regexp_matches(text, '(?i)Tabelle\s+\d')) AS table_pages, sum(w)::BIGINT AS words, sum(n_images)::BIGINT AS images, sum(length(text))::BIGINT AS chars FROM p GROUP BY ALL)"""
_RATIOS = "text_pages / n_pages AS coverage, words / nullif(text_pages, 0) AS words_per_page, n_pages / nullif(image_pages, 0) AS density, chars / nullif(images, 0) AS chars_per_image"


def _pages(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return profile.page_profile(p.select("source", "doc_id", "text", ((F.col("i") + 1) % 3).cast("long").alias("n_images")), ["source", "doc_id"])


@query(f"WITH {_PAGES} SELECT *, {_RATIOS} FROM d")
def page_profile(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.withColumns({c: F.col(c).cast("long") for c in ("words", "images", "chars")})


@query(f"""WITH {_PAGES},
r AS (SELECT CASE WHEN grouping(source) = 1 THEN 'GESAMT' ELSE source END AS source, count(*) AS n_docs, sum(n_pages)::BIGINT AS n_pages, sum(text_pages)::BIGINT AS text_pages, sum(image_pages)::BIGINT AS image_pages, sum(table_pages)::BIGINT AS table_pages, sum(words)::BIGINT AS words, sum(images)::BIGINT AS images, sum(chars)::BIGINT AS chars FROM d GROUP BY ROLLUP (source))
SELECT *, {_RATIOS} FROM r""")
def source_rollup(spark, sf_dir):
    return profile.profile_rollup(_pages(spark, sf_dir), "source")


@query(f"WITH {_PAGES}, q AS (SELECT words / nullif(text_pages, 0) AS w, text_pages / n_pages AS c FROM d) SELECT count(*) AS n_docs, round(avg(w), 6) AS words_per_page, round(avg(c), 6) AS coverage FROM q")
def mean_of_means(spark, sf_dir):
    m = profile.mean_of_means(_pages(spark, sf_dir))
    return m.select("n_docs", F.round("words_per_page", 6).alias("words_per_page"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_OUTLINE} SELECT doc_id::VARCHAR AS doc_id, count(*)::INTEGER AS n_entries, max(level)::INTEGER AS depth FROM o GROUP BY doc_id")
def outline_profile(spark, sf_dir):
    return profile.outline_profile(gold(spark, sf_dir, "handbuch")).select("doc_id", "n_entries", "depth")


@query("""
SELECT CASE WHEN s < 100 THEN '<100' WHEN s < 300 THEN '100-299' WHEN s < 800 THEN '300-799' ELSE '>=800' END AS bucket, count(*) AS n, count(*) FILTER (s >= 300) AS n_relevant
FROM (SELECT greatest(p_size * 20, 40) AS s FROM part) GROUP BY ALL
""")
def image_sizes(spark, sf_dir):
    return profile.image_sizes(table(spark, sf_dir, "part").select((F.col("p_size") * 20).alias("width"), F.lit(40).alias("height")))


@query("SELECT strftime(to_timestamp(min(s)), '%Y-%m-%d') AS first, strftime(to_timestamp(max(s)), '%Y-%m-%d') AS last, ((max(s) - min(s)) // 86400)::BIGINT AS days FROM (SELECT epoch(o_orderdate)::BIGINT AS s FROM orders)")
def time_span(spark, sf_dir):
    return profile.time_span(table(spark, sf_dir, "orders").select(F.unix_timestamp("o_orderdate").alias("s")), "s")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_rates(spark, sf_dir):
    r = ingest.event_rates(table(spark, sf_dir, "events"))
    return r.withColumns({"start": F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "value": F.round("value", 4)})


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n FROM s GROUP BY user_id, s
""")
def sessions(spark, sf_dir):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return ingest.sessions(table(spark, sf_dir, "events")).withColumns({"start": text("start"), "end": text("end")})
