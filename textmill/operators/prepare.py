"""Bronze to silver to gold for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textmill.functions import lookups
from textmill.functions import text as X
from textmill.schemas import GOLD, METADATA

_TEXT_FIELDS = ("KATEGORIE", "VERSION", "VERSIONERL", "BESCHREIBU", "FEHLER", "LOESUNG", "BEARBEITET")


def dedupe_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, not a window: equal rows meet
    in their own task first, so a key with a third of all rows is no hot spot.
    The hash goes ahead of long keys in comparisons."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(F.xxhash64(*key).alias("_hash"), *key).agg(first).select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def changes(df: DataFrame, seen: Observation, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Counts, as the data pass by, the rows in which a step changed a text."""
    return df.observe(seen, *[F.count_if(~a.eqNullSafe(b)).alias(n) for n, (a, b) in pairs.items()])


def forum_silver(posts: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Cleaned posts: empty texts go, then all but the first of equal texts."""
    if seen is not None:
        t = F.coalesce("post_text", F.lit(""))
        posts = changes(posts, seen, {"html": (t, F.regexp_replace(t, X.TAG, "")), "bbcode": (t, F.regexp_replace(t, X.BBCODE, "")), "any": (t, X.clean_markup(t, entities=False))})
    s = posts.withColumn("post_subject", X.clean_markup(F.col("post_subject"))).withColumn("post_text", X.clean_markup(F.col("post_text")))
    s = lookups.resolve(s, "forum_id", "module", lookups.FORUM_MODULES).withColumn("post_date", X.epoch_date(F.col("post_time")))
    return dedupe_first(s.where("post_text <> ''"), ["post_text"], ["src_pos"])


def ticket_silver(tickets: DataFrame, seen: Observation | None = None, entities: bool = True) -> DataFrame:
    """Cleaned tickets with a solution; labels resolved."""
    s = tickets.withColumns({c: X.normalize_space(F.col(c)) for c in _TEXT_FIELDS})
    if seen is not None:
        s = changes(s, seen, {f"signature_{c}": (F.col(c), X.remove_signature(F.col(c))) for c in ("FEHLER", "LOESUNG")})
    s = s.withColumns({c: X.clean_ticket(X.remove_signature(F.col(c)), entities) for c in ("FEHLER", "LOESUNG")})
    s = lookups.resolve(s, "PRODUKTID", "product", lookups.PRODUCTS)
    s = lookups.resolve(s, "STATUSID", "status", lookups.TICKET_STATES)
    return s.withColumn("processed_date", F.substring(F.coalesce("BEARBEITET", F.lit("")), 1, 10)).where("LOESUNG <> ''")


def paged_silver(docs: DataFrame) -> DataFrame:
    """Page-structured documents without boilerplate lines, with full text
    and counts; the nested columns stay nested."""
    clean = docs.withColumn("pages", F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), X.remove_boilerplate(p["text"]).alias("text"))))
    full = F.array_join(F.filter(F.transform("pages", lambda p: p["text"]), lambda t: t != ""), "\n\n")
    return clean.withColumn("full_text", full).withColumn("page_count", F.size("pages")).withColumn("image_count", F.size(F.coalesce("images", F.array())))


def _gold(doc_id: Column, source: Column, meta: dict[str, Column], full_text: Column, outline: Column | None = None, pages: Column | None = None, images: Column | None = None) -> list[Column]:
    kind = {f.name: f.dataType for f in GOLD}
    blank = lambda t: F.lit(None).cast(t)
    fields = [(meta[f.name] if f.name in meta else F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA]
    content = kind["content"]
    empty = lambda name: blank(content[name].dataType)
    return [
        doc_id.alias("doc_id"),
        source.alias("source_type"),
        F.struct(*fields).alias("metadata"),
        F.struct(full_text.alias("full_text"), (outline if outline is not None else empty("outline")).alias("outline"), (pages if pages is not None else empty("pages")).alias("pages")).alias("content"),
        (images if images is not None else blank(kind["images"])).alias("images"),
    ]


def forum_gold(silver: DataFrame) -> DataFrame:
    """Missing values are empty strings."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    meta = {"post_id": text("post_id"), "topic_id": text("topic_id"), "module": text("module"), "post_date": text("post_date"), "title": text("post_subject")}
    return silver.select(*_gold(F.concat(F.lit("forum_"), text("post_id")), F.lit("forum"), meta, F.concat(text("post_subject"), F.lit("\n\n"), text("post_text"))))


def ticket_gold(silver: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    meta = {
        "ticket_id": text("ID"), "category": text("KATEGORIE"), "version_reported": text("VERSION"), "version_resolved": text("VERSIONERL"),
        "product": text("product"), "status": text("status"), "processed_date": text("processed_date"), "title": text("BESCHREIBU"),
    }
    full = F.concat(text("BESCHREIBU"), F.lit("\n\nFehlerbeschreibung:\n"), text("FEHLER"), F.lit("\n\nLösung:\n"), text("LOESUNG"))
    return silver.select(*_gold(F.concat(F.lit("ticket_"), text("ID")), F.lit("ticket"), meta, full))


def paged_gold(silver: DataFrame, source_type: str, root: str = "") -> DataFrame:
    """source_type: handbuch, modulbeschreibung or schulungsunterlage."""
    meta = {"filename": F.col("filename"), "page_count": F.col("page_count"), "image_count": F.col("image_count")}
    shot = lambda i: F.struct(i["image_id"].alias("image_id"), i["page"].alias("page"), (X.relative_path(i["filepath"], root) if root else i["filepath"]).alias("filepath"), i["width"].alias("width"), i["height"].alias("height"))
    return silver.select(*_gold(F.col("doc_id"), F.lit(source_type), meta, F.col("full_text"), F.col("outline"), F.col("pages"), F.transform("images", shot)))
