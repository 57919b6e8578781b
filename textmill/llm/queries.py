"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import collocation, decontaminate, divergence, html_text, language, lm_score, near_dedup, packing, perplexity, quality_rules, secret_scan, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(_read(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_near_dedup, op3_quality_classifier, op4_packing, op5_token_counts, op6_decontamination, op7_quality_rules, op8_lm_scoring, op9_toxicity, op10_html_extraction, op11_source_divergence, op12_collocations, op13_secret_scan)}


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dg AS (SELECT r, k, i, list_slice(w, i, i + k - 1) AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bg) WHERE len(w) >= k)),
h AS (SELECT DISTINCT dg.r, dg.i, dg.k, bg.item_id FROM dg JOIN bg ON dg.k = bg.k AND dg.g = bg.g),
p AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT r, i, k FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p ON d.r = p.r LEFT JOIN t ON d.r = t.r
"""


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(list_filter(string_split_regex({_LOWERED.format("text")}, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS n FROM f GROUP BY lang, source),
p AS (SELECT f.lang, f.source, f.term, f.n,
             (1 + (1000000000::HUGEINT * (f.n + 5)) // (s.n + 5 * v.v)::HUGEINT)::BIGINT AS p,
             (1 + (1000000000::HUGEINT * (f.all_n + 5)) // (v.n + 5 * v.v)::HUGEINT)::BIGINT AS q
      FROM f JOIN s ON f.lang = s.lang AND f.source = s.source JOIN v ON f.lang = v.lang),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INTEGER AS rank
FROM p WHERE n > 0 AND p > q QUALIFY rank <= 50
"""

OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
totals AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, list_slice(w, i, i + m - 1) AS g, count(*) AS f
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) AS ms(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100),
inner_g AS (SELECT DISTINCT lang, list_slice(g, i, i + k - 1) AS g, f FROM (SELECT lang, g, f, m, k, unnest(range(1, m - k + 2)) AS i FROM g, range(2, 5) AS ks(k) WHERE k < m)),
kept AS (SELECT g.* FROM g ANTI JOIN inner_g h ON g.lang = h.lang AND g.g = h.g AND h.f >= g.f WHERE TRUE),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
         FROM (SELECT *, unnest(range(1, m)) AS k FROM kept WHERE m >= 2) c
         JOIN g l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, k) JOIN g r ON r.lang = c.lang AND r.g = list_slice(c.g, k + 1, c.m) JOIN totals t ON t.lang = c.lang),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM low QUALIFY rank <= 2000
"""


def _secrets_sql() -> str:
    base, parts = len(secret_scan.BASE), []
    for i, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"SELECT r, {i} AS k, '{r.kind}' AS kind, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS m, list_transform(regexp_extract_all(text, '{p}', {r.group}), lambda x: length(x) >= {r.least}) AS ok FROM d WHERE regexp_matches(text, '{p}')")
    names = lambda where: f"coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k){where}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT r, k, kind, ok[i] AS ok, length(m[i]) AS size, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS b
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
f AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {names(f" FILTER (k < {base})")} AS base, {names("")} AS spans
      FROM (SELECT *, b + size AS e FROM s WHERE ok) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f ON d.r = f.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6_SQL, "op11_source_divergence": OP11_SQL, "op12_collocations": OP12_SQL, "op13_secret_scan": _secrets_sql()}
