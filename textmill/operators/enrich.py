"""Structural metadata and keywords for chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import providers
from textmill.functions import text as X
from textmill.functions.tokens import WORDS, Tokenizer
from textmill.operators import chunk

# The quality gate of keywords, the prompt's token limit, and
# prices in USD per million tokens with the sums that stop a run.
FEW_KEYWORDS, MOST_FEW_RATE = 3, 0.05
PROMPT_TOKENS = 2000
PRICES = {"embedding": 0.13, "keywords_in": 0.15, "keywords_out": 0.60}
COST_STOPS = {"embedding": 2.0, "keywords": 5.0}


def section_pages(outline: Column, path: Column) -> Column:
    """(start, end) of the first outline entry with the path's last title and
    its depth as level; the end is the page of the next entry of that level or
    less, else one past the outline's last page. Not found: (0, 0)."""
    at = F.array_position(F.transform(outline, lambda e: (e["level"] == F.size(path)) & (e["title"] == F.try_element_at(path, F.lit(-1)))), True).cast("int")
    after = F.filter(F.slice(outline, at + 1, F.size(outline)), lambda e: e["level"] <= F.size(path))
    last = F.array_max(F.transform(outline, lambda e: e["page"])) + 1
    found = F.struct(F.get(outline, at - 1)["page"].alias("start"), F.coalesce(F.get(after, 0)["page"], last).alias("end"))
    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    return F.when((F.coalesce(F.size(path), F.lit(0)) > 0) & (F.coalesce(at, F.lit(0)) > 0), found).otherwise(none)


#: Metadata of each source: chunk column -> field of the document's metadata.
FIELDS = {
    "forum": {"post_id": "post_id", "topic_id": "topic_id", "module_lookup": "module", "post_date": "post_date"},
    "ticket": {"ticket_id": "ticket_id", "product": "product", "category": "category", "version_reported": "version_reported", "version_resolved": "version_resolved", "processed_date": "processed_date"},
}


def with_metadata(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Joins chunks with their documents on (source_type, doc_id) and adds the
    source's fields; missing values are empty. A chunk without a document is
    kept, its fields null. Only the needed document columns are shuffled."""
    slim = docs.select("source_type", "doc_id", F.col("metadata").alias("_m"), F.when(F.col("source_type") == "handbuch", F.col("content.outline")).alias("_o"), F.lit(True).alias("_found"))
    j = chunks.join(slim, ["source_type", "doc_id"], "left")
    cols: dict[str, Column] = {}
    for source, fields in FIELDS.items():
        for name, field in fields.items():
            cols[name] = F.when(F.col("_found") & (F.col("source_type") == source), F.coalesce(F.col(f"_m.{field}"), F.lit("")))
    manual = F.col("_found") & (F.col("source_type") == "handbuch")
    path = F.coalesce("outline_path", F.array().cast("array<string>"))
    span = section_pages(F.coalesce("_o", F.array()), path)
    j = j.withColumn("_span", F.when(manual, span))
    cols |= {
        "outline_level": F.when(manual, F.size(path)),
        "page_start": F.col("_span.start"),
        "page_end": F.col("_span.end"),
        "doc_title": F.when(F.col("_found") & F.col("source_type").isin("handbuch", "modulbeschreibung", "schulungsunterlage"), X.doc_title(F.col("source_file"))),
        "module_filename": F.when(F.col("_found") & (F.col("source_type") == "schulungsunterlage"), X.module_of(F.col("doc_id"))),
    }
    return j.withColumns(cols).withColumn("outline_path", F.when(manual, X.outline_path(path)).otherwise(F.array_join("outline_path", " > "))).drop("_m", "_o", "_found", "_span")


def missing_metadata(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids of chunks without a document."""
    return chunks.join(docs.select("source_type", "doc_id"), ["source_type", "doc_id"], "left_anti").select("id")


def keyword_prompts(chunks: DataFrame, tok: Tokenizer = WORDS) -> DataFrame:
    """id, prompt: the first tokens of each chunk."""
    return chunks.select("id", F.array_join(F.slice(tok.split(F.col("text")), 1, PROMPT_TOKENS), "").alias("prompt"))


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(cache.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def new_keywords(chunks: DataFrame, cache: DataFrame, provider: Callable, tok: Tokenizer = WORDS) -> DataFrame:
    """chunk_id, keywords of the chunks that the cache lacks. Write it with
    ``sinks.append_cache`` before it is used, so no call is made twice."""
    made = providers.apply(keyword_prompts(cache_misses(chunks, cache), tok), "prompt", "keywords", "array<string>", provider)
    return made.select(F.col("id").alias("chunk_id"), X.valid_keywords(F.col("keywords")).alias("keywords"))


def few_keyword_rate(keyworded: DataFrame) -> DataFrame:
    """n_chunks, n_few, few_rate, ok over chunks with a keywords array."""
    few = F.size(F.coalesce("keyword_list", F.array())) < FEW_KEYWORDS
    return keyworded.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(few).alias("n_few"), F.coalesce(F.avg(few.cast("int")), F.lit(0.0)).alias("few_rate")).withColumn("ok", F.col("few_rate") <= MOST_FEW_RATE)


def with_keywords(chunks: DataFrame, cache: DataFrame, gate: bool = True) -> DataFrame:
    """Adds keyword_list and keywords (comma-joined). With ``gate`` a call in
    which over 5 % of the chunks have fewer than three keywords raises."""
    j = chunks.join(cache.select(F.col("chunk_id").alias("id"), F.col("keywords").alias("keyword_list")), "id", "left")
    j = j.withColumn("keyword_list", F.coalesce("keyword_list", F.array().cast("array<string>"))).withColumn("keywords", X.joined_keywords(F.col("keyword_list")))
    if gate and not (r := few_keyword_rate(j).first())["ok"]:
        raise RuntimeError(f"{r['n_few']} of {r['n_chunks']} chunks have fewer than {FEW_KEYWORDS} keywords")
    return j


def v2(docs: DataFrame, cache: DataFrame, tok: Tokenizer = WORDS, gate: bool = True) -> DataFrame:
    return with_keywords(with_metadata(chunk.v1(docs, tok), docs), cache, gate)


def v4(docs: DataFrame, cache: DataFrame, merged: DataFrame, filename: str, tok: Tokenizer = WORDS, gate: bool = True) -> DataFrame:
    """As v2, but the documents of ``filename`` go page by page with image
    descriptions. merged: the result of ``chunk.merge_images``."""
    illustrated = F.coalesce(F.col("metadata.filename") == filename, F.lit(False))
    own = with_metadata(chunk.by_page_with_images(docs.where(illustrated), merged), docs.where(illustrated))
    rest = docs.where(~illustrated)
    return with_keywords(with_metadata(chunk.v1(rest, tok), rest).unionByName(own), cache, gate)


def chunker(variant: str, **needs: object) -> Callable[[DataFrame], DataFrame]:
    """The chunker of a variant; v3 shares v2's. Unknown variants raise."""
    tok = needs.get("tok", WORDS)
    table: dict[str, Callable[[DataFrame], DataFrame]] = {
        "v0": lambda d: chunk.v0(d, tok),
        "v1": lambda d: chunk.v1(d, tok),
        "v2": lambda d: v2(d, needs["cache"], tok),
        "v3": lambda d: v2(d, needs["cache"], tok),
        "v4": lambda d: v4(d, needs["cache"], needs["merged"], needs["filename"], tok),
    }
    if variant not in table:
        raise ValueError(f"unknown variant {variant!r}")
    return table[variant]


def describe_images(images: DataFrame, cache: DataFrame, provider: Callable, least: int = 300) -> DataFrame:
    """Descriptions of large enough images that the cache lacks. images:
    image_id, page, width, height, url (data URL)."""
    todo = images.where(X.is_relevant_image(F.col("width"), F.col("height"), least)).join(cache.select("image_id"), "image_id", "left_anti")
    made = providers.apply(todo, "url", "vlm_description", "string", provider, batch=1)
    return made.where("vlm_description is not null").select("image_id", "page", "width", "height", "vlm_description")


def embed(chunks: DataFrame, provider: Callable, text_col: str = "text", out: str = "embedding") -> DataFrame:
    return providers.apply(chunks, text_col, out, "array<float>", provider)


def cost_estimate(chunks: DataFrame, tok: Tokenizer = WORDS) -> DataFrame:
    """Tokens to embed, tokens of keyword prompts, costs, and whether the
    costs stay below the stops."""
    n = tok.count(F.col("text"))
    t = chunks.agg(F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.least(n, F.lit(PROMPT_TOKENS))), F.lit(0)).alias("prompt_tokens"))
    t = t.withColumn("embedding_usd", F.col("tokens") * PRICES["embedding"] / 1e6).withColumn("keywords_usd", F.col("prompt_tokens") * PRICES["keywords_in"] / 1e6)
    return t.withColumn("ok", (F.col("embedding_usd") <= COST_STOPS["embedding"]) & (F.col("keywords_usd") <= COST_STOPS["keywords"]))
