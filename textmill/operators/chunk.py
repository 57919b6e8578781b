"""Chunkers: documents to chunks, one row per chunk.

A chunk is id, text, source_type, doc_id, source_file, chunk_index,
chunking_strategy, page_number, outline_path. Texts are cut by higher-order
functions inside their row; only the running numbers of a document's sections
need its rows together, and the shuffle for that is on the document key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import is_blank, once, strip
from textmill.functions.tokens import WORDS, Tokenizer, windows
from textmill.storage import written

# Window sizes and overlaps, and token limits.
V0_WINDOW = (1000, 150)
FALLBACK_WINDOW = (1500, 100)
ATOMIC_LIMIT, SECTION_LIMIT = 8000, 2000

#: Entries, bounds or pages of a task that puts them in order.
SORTED = 50_000

COLUMNS = ("id", "text", "source_type", "doc_id", "source_file", "chunk_index", "chunking_strategy", "page_number", "outline_path")
_KEY = ("source_type", "doc_id")


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(
        "source_type",
        "doc_id",
        F.coalesce("metadata.filename", F.lit("unknown")).alias("source_file"),
        F.coalesce("content.full_text", F.lit("")).alias("full_text"),
        F.coalesce("content.outline", F.array()).alias("outline"),
        F.coalesce("content.pages", F.array()).alias("pages"),
    )


def _id(*parts: Column | str) -> Column:
    return F.concat("source_type", F.lit("__"), "doc_id", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _number(c: Column) -> Column:
    return F.format_string("%04d", c)


def _shape(df: DataFrame, id_: Column, index: Column, strategy: Column, page: Column | None = None, path: Column | None = None) -> DataFrame:
    return df.select(
        id_.alias("id"),
        "text",
        "source_type",
        "doc_id",
        "source_file",
        index.cast("int").alias("chunk_index"),
        strategy.alias("chunking_strategy"),
        (page if page is not None else F.lit(None)).cast("int").alias("page_number"),
        (path if path is not None else F.lit(None)).cast("array<string>").alias("outline_path"),
    )


def _cut(df: DataFrame, limit: int, tok: Tokenizer) -> DataFrame:
    """Adds parts and whole: a text within the limit is its only part, a
    longer one is cut into fallback windows. A token has at least one byte, so
    texts of at most ``limit`` bytes are not cut into tokens."""
    t = once(df, "tokens", F.when(F.octet_length("text") > limit, tok.split(F.col("text"))))
    whole = F.coalesce(F.size("tokens") <= limit, F.lit(True))
    return t.withColumn("whole", whole).withColumn("parts", F.when(whole, F.array("text")).otherwise(windows(F.col("tokens"), *FALLBACK_WINDOW))).drop("tokens")


def _longer(text: str, limit: int, tok: Tokenizer) -> Column:
    return F.when(F.octet_length(text) > limit, tok.count(F.col(text)) > limit).otherwise(False)


def v0(docs: DataFrame, tok: Tokenizer = WORDS, size: int = V0_WINDOW[0], overlap: int = V0_WINDOW[1]) -> DataFrame:
    """Windows over the full text, whatever the source."""
    t = once(_base(docs).drop("outline", "pages"), "tokens", tok.split(F.col("full_text"))).drop("full_text")
    t = t.select(*_KEY, "source_file", F.posexplode(windows(F.col("tokens"), size, overlap)).alias("i", "text"))
    return _shape(t, _id("_chunk_", _number(F.col("i"))), F.col("i"), F.lit(None).cast("string"))


def atomic(docs: DataFrame, tok: Tokenizer = WORDS) -> DataFrame:
    """The full text as one chunk, empty ones too; very long ones are cut."""
    t = _cut(_base(docs).withColumnRenamed("full_text", "text").drop("outline", "pages"), ATOMIC_LIMIT, tok)
    t = t.drop("text").select("*", F.posexplode("parts").alias("i", "text"))
    return _shape(t, F.when(F.col("whole"), _id()).otherwise(_id("_overflow_recursive_", _number(F.col("i")))), F.col("i"), F.when(F.col("whole"), "atomic").otherwise("recursive_fallback"))


def by_page(docs: DataFrame, tok: Tokenizer = WORDS) -> DataFrame:
    """A chunk per page that has text; chunk_index counts over the document."""
    t = _base(docs).select(*_KEY, "source_file", F.posexplode("pages").alias("at", "page"))
    t = t.select(*_KEY, "source_file", "at", F.col("page.page_number").alias("page_number"), strip(F.coalesce("page.text", F.lit(""))).alias("text")).where("text <> ''")
    t = _cut(t, SECTION_LIMIT, tok).drop("text")
    before = Window.partitionBy(*_KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("start", F.coalesce(F.sum(F.size("parts")).over(before), F.lit(0)))
    t = t.select("*", F.posexplode("parts").alias("i", "text")).withColumn("n", F.col("start") + F.col("i"))
    page = F.concat(F.lit("_page_"), _number(F.col("page_number")))
    return _shape(t, F.when(F.col("whole"), _id(page)).otherwise(_id(page, F.lit("_recursive_"), _number(F.col("n")))), F.col("n"), F.when(F.col("whole"), "page").otherwise("recursive_fallback"), F.col("page_number"))


def entries(docs: DataFrame) -> DataFrame:
    """The outline entries of each document: at, level, title, page, and last,
    one past the document's last page. docs: key columns, outline, pages."""
    keys = [c for c in docs.columns if c not in ("outline", "pages")]
    last = F.array_max(F.transform("pages", lambda p: p["page_number"])) + 1
    return docs.select(*keys, last.alias("last"), F.posexplode("outline").alias("at", "e")).select(*keys, "last", "at", "e.level", "e.title", "e.page")


def _dealt(rows: DataFrame, keys: tuple[str, ...], n: int | None) -> DataFrame:
    """``rows``, of which there are about ``n``, dealt by key to so many tasks
    that each sorts about ``SORTED`` of them. Left to itself, Spark joins
    partitions by their compressed size, and such rows shrink so much that the
    few tasks that remain would sort more and more as the input grows."""
    return rows if n is None else rows.repartition(max(1, -(-n // SORTED)), *keys)


def sections(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), n: int | None = None) -> DataFrame:
    """The level-2 sections of each outline: keys, h2_at, h1, title, start, end.

    h1 is the last level-1 title before; the end is the page of the next entry
    of level 2 or less, else one past the last page. Both are carried along the
    document's entries, each by one running window, in outline order and back.
    n: about how many entries there are, where known.
    """
    every = Window.partitionBy(*keys)
    carried = lambda when, c, w: F.last(F.when(when, F.struct(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))[c]
    e = _dealt(entries(docs.select(*keys, "outline", "pages")), keys, n)
    e = e.withColumn("h1", carried(F.col("level") == 1, "title", every.orderBy("at"))).withColumn("end", carried(F.col("level") <= 2, "page", every.orderBy(F.desc("at"))))
    return e.where("level = 2").select(*keys, F.col("at").alias("h2_at"), F.coalesce("h1", F.lit("")).alias("h1"), "title", F.col("page").alias("start"), F.coalesce("end", "last").alias("end"))


def inside(ranges: DataFrame, points: DataFrame, keys: tuple[str, ...], of_range: tuple[str, ...], n: int | None = None) -> DataFrame:
    """Which points lie in which range: keys, of_range, rank.

    ranges: keys, of_range (which name a range), start, end (half-open);
    points: keys, rank (from 1, in order of value), value. A key's ranges and
    points meet in one sorted stream, where each bound counts the points before
    it; the points of a range are the ranks between its two counts. So the work
    is that of a sort and of the result, however many ranges and points there
    are, and ranges may overlap. A null bound holds nothing. n: about how many
    ranges and points there are, where known.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("value")) for i, c in enumerate(("start", "end"))]))
    bounds = ranges.select(*keys, *of_range, sides.alias("b")).select(*keys, *of_range, "b.*").where("value is not null")
    stream = bounds.withColumn("point", F.lit(0)).unionByName(points.select(*keys, "value").withColumn("point", F.lit(1)), allowMissingColumns=True)
    stream = _dealt(stream, keys, n)
    before = Window.partitionBy(*keys).orderBy("value", "point").rowsBetween(Window.unboundedPreceding, 0)
    counted = stream.withColumn("n", F.sum("point").over(before)).where("point = 0")
    one = lambda i: F.max(F.when(F.col("side") == i, F.col("n")))
    spans = counted.groupBy(*keys, *of_range).agg(one(0).alias("low"), one(1).alias("high")).where("low < high")
    return spans.select(*keys, *of_range, F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("rank"))


def _points(docs: DataFrame, value: str, what: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """The elements of an array as points, in order of a field of them: keys,
    rank, value, at (place in the array), e (the element)."""
    placed = F.transform(what, lambda e, i: F.struct(e[value].alias("value"), i.alias("at"), e.alias("e")))
    chosen = F.filter(placed, lambda x: x["value"].isNotNull() & (keep(x["e"]) if keep else F.lit(True)))
    # ordered by value and place alone: elements need not be comparable, and equal ones of both don't exist
    order = lambda x, y: F.when(x["value"] < y["value"], -1).when(x["value"] > y["value"], 1).otherwise(F.when(x["at"] < y["at"], -1).otherwise(1))
    each = docs.select(*_KEY, F.posexplode(F.array_sort(chosen, order)).alias("rank", "x"))
    return each.select(*_KEY, (F.col("rank") + 1).cast("long").alias("rank"), "x.value", "x.at", "x.e")


def page_points(docs: DataFrame) -> DataFrame:
    """The pages of each document that have a number, as points: keys, rank,
    value (the number), at, text (stripped)."""
    return _points(docs, "page_number", "pages").select(*_KEY, "rank", "value", "at", strip(F.coalesce("e.text", F.lit(""))).alias("text"))


def ranges_text(pages: DataFrame, ranges: DataFrame, of_range: tuple[str, ...], n: int | None = None) -> DataFrame:
    """keys, of_range, text: the texts of the pages in each range, blank ones
    left out, joined in the pages' order; ranges without text go. pages: the
    result of ``page_points``."""
    met = inside(ranges, pages, _KEY, of_range, n).join(pages.select(*_KEY, "rank", "at", "text").where("text <> ''"), [*_KEY, "rank"])
    ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
    return met.groupBy(*_KEY, *of_range).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def h3_sections(docs: DataFrame, h2: DataFrame, n: int | None = None) -> DataFrame:
    """keys, h2_at, h3_at, title, start, end: the level-3 entries on pages of
    each section's range, wherever they stand in the outline; an entry ends at
    the page of the next of them, the last one with the section."""
    points = _points(docs, "page", "outline", lambda e: e["level"] == 3)
    ranges = h2.select(*_KEY, "h2_at", "start", "end")
    met = inside(ranges, points, _KEY, ("h2_at",), n).join(points.select(*_KEY, "rank", F.col("at").alias("h3_at"), F.col("e.title").alias("title"), F.col("value").alias("start")), [*_KEY, "rank"])
    met = met.join(ranges.select(*_KEY, "h2_at", F.col("end").alias("h2_end")), [*_KEY, "h2_at"])
    following = F.lead("start").over(Window.partitionBy(*_KEY, "h2_at").orderBy("h3_at"))
    return met.select(*_KEY, "h2_at", "h3_at", "title", "start", F.coalesce(following, "h2_end").alias("end"))


def by_outline(docs: DataFrame, tok: Tokenizer = WORDS) -> DataFrame:
    """A chunk per level-2 section; too long ones go by level 3, then by
    windows. Without outline, pages or level-2 entries: windows.

    Pages, outlines, sections and their texts are written once and read by all
    that need them, so the documents are read and cut into pages once."""
    base = _base(docs)
    usable = F.exists("outline", lambda e: e["level"] == 2) & (F.size("pages") > 0)
    flat = once(base.where(~usable).drop("outline", "pages"), "tokens", tok.split(F.col("full_text"))).drop("full_text")
    flat = flat.select(*_KEY, "source_file", F.posexplode(windows(F.col("tokens"), *FALLBACK_WINDOW)).alias("i", "text"))
    flat = _shape(flat, _id("_nooutline_recursive_", _number(F.col("i"))), F.col("i"), F.lit("recursive_fallback"))

    own = base.where(usable).drop("full_text")
    pages = written(page_points(own))
    own = written(own.withColumn("pages", F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number")))))
    n_pages, n_entries = pages.count(), own.agg(F.sum(F.size("outline"))).first()[0] or 0
    h2 = written(sections(own, _KEY, n_entries))
    n_h2 = h2.count()
    h3 = written(h3_sections(own, h2, n_entries + 2 * n_h2))
    has_h3 = h3.select(*_KEY, "h2_at").distinct().withColumn("finer", F.lit(True))
    whole = ranges_text(pages, h2, ("h2_at",), n_pages + 2 * n_h2).join(has_h3, [*_KEY, "h2_at"], "left")
    whole = written(whole.withColumn("finer", F.coalesce("finer", F.lit(False)) & _longer("text", SECTION_LIMIT, tok)))
    h3 = h3.join(whole.where("finer").select(*_KEY, "h2_at"), [*_KEY, "h2_at"], "left_semi")
    named = h2.select(*_KEY, "h2_at", "h1", F.col("title").alias("h2"))
    path = lambda *more: F.array("h1", "h2", *more).alias("path")
    coarse = whole.where("not finer").join(named, [*_KEY, "h2_at"]).select(*_KEY, "h2_at", F.lit(-1).alias("h3_at"), F.lit("h2").alias("kind"), path(), "text")
    fine = ranges_text(pages, h3, ("h2_at", "h3_at"), n_pages + 2 * n_entries).join(h3.select(*_KEY, "h2_at", "h3_at", "title"), [*_KEY, "h2_at", "h3_at"]).join(named, [*_KEY, "h2_at"])
    p = coarse.unionByName(fine.select(*_KEY, "h2_at", "h3_at", F.lit("h3").alias("kind"), path("title"), "text"))
    p = p.join(own.select(*_KEY, "source_file"), [*_KEY])
    p = _cut(p, SECTION_LIMIT, tok).drop("text")
    before = Window.partitionBy(*_KEY).orderBy("h2_at", "h3_at").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("start", F.coalesce(F.sum(F.size("parts")).over(before), F.lit(0)).cast("int"))
    p = p.select("*", F.posexplode("parts").alias("i", "text")).withColumn("n", F.col("start") + F.col("i"))
    head = F.concat(F.lit("_"), "kind", F.lit("_"), _number(F.col("start")))
    cut = _shape(p, F.when(F.col("whole"), _id(head)).otherwise(_id(head, F.lit("_recursive_"), _number(F.col("n")))), F.col("n"), F.when(F.col("whole"), "outline").otherwise("recursive_fallback"), path=F.col("path"))
    return cut.unionByName(flat)


#: Chunker by source type; other types are cut by ``v0``.
BY_SOURCE: dict[str, Callable[..., DataFrame]] = {"forum": atomic, "ticket": atomic, "modulbeschreibung": by_page, "schulungsunterlage": by_page, "handbuch": by_outline}


def v1(docs: DataFrame, tok: Tokenizer = WORDS) -> DataFrame:
    """Each source by its own chunker, in one union of filtered branches."""
    kinds: dict[Callable[..., DataFrame], list[str]] = {}
    for source, f in BY_SOURCE.items():
        kinds.setdefault(f, []).append(source)
    parts = [f(docs.where(F.col("source_type").isin(sources)), tok) for f, sources in kinds.items()]
    parts.append(v0(docs.where(~F.col("source_type").isin(*BY_SOURCE)), tok))
    return reduce(DataFrame.unionByName, parts)


def merge_images(blocks: DataFrame, images: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Page texts with image marks where the images stand.

    blocks: source_type, doc_id, page_number, pos, y, text. images: source_type,
    doc_id, page_number, index, y. descriptions: image_id, vlm_description; an
    image without one is left out. Equal heights: text first, then position.
    """
    image_id = F.format_string("schulung_auftrag_einsteiger_p%03d_img%02d", "page_number", "index")
    marks = images.withColumn("image_id", image_id).join(descriptions.select("image_id", "vlm_description"), "image_id")
    marks = marks.select(*_KEY, "page_number", "y", F.lit(1).alias("kind"), F.col("index").alias("pos"), F.concat(F.lit("[Bild: "), "vlm_description", F.lit("]")).alias("text"))
    texts = blocks.select(*_KEY, "page_number", "y", F.lit(0).alias("kind"), "pos", strip(F.col("text")).alias("text")).where("text <> ''")
    order = F.sort_array(F.collect_list(F.struct("y", "kind", "pos", "text")))
    return texts.unionByName(marks).groupBy(*_KEY, "page_number").agg(F.array_join(F.transform(order, lambda e: e["text"]), "\n\n").alias("text"))


def by_page_with_images(docs: DataFrame, merged: DataFrame) -> DataFrame:
    """A chunk per page of any length; chunk_index is the page's position,
    pages without text counted too. merged: the result of ``merge_images``."""
    t = _base(docs).select(*_KEY, F.when(F.col("source_file") == "unknown", "").otherwise(F.col("source_file")).alias("source_file"), F.posexplode("pages").alias("at", "page"))
    t = t.select(*_KEY, "source_file", "at", F.col("page.page_number").alias("page_number")).join(merged, [*_KEY, "page_number"]).where(~is_blank(F.col("text")))
    return _shape(t, _id("_page_", _number(F.col("page_number"))), F.col("at"), F.lit("page_v4"), F.col("page_number"))


def strategy_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_type", F.coalesce("chunking_strategy", F.lit("unknown")).alias("chunking_strategy")).agg(F.count(F.lit(1)).alias("n_chunks"))


def limited(chunks: DataFrame, n: int) -> DataFrame:
    """The first n chunks in order of document and chunk (a trial index)."""
    return chunks.orderBy(*_KEY, "chunk_index").limit(n)
