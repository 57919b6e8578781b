"""Corpus profiles: frequencies, completeness, lengths, duplicates, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators.select import percentiles


def frequencies(df: DataFrame, value: Column, top: int | None = None) -> DataFrame:
    """value, n and share in percent, the most frequent first; ties by value."""
    t = df.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    f = t.crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("share")).orderBy(F.desc("n"), "value")
    return f.limit(top) if top else f


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a blank value, per column, and rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(X.is_blank(F.col(c).cast("string"))).alias(f"{c}_blank") for c in columns])


def lengths(df: DataFrame, text: str, keys: list[str] | None = None) -> DataFrame:
    """Words per text: n, mean, median, least, most, and three buckets."""
    w = X.word_count(F.col(text))
    own = df.select(*(keys or []), w.alias("w")).where("w > 0")
    key = F.struct(*keys) if keys else F.struct(F.lit(1).alias("all"))
    aggregates = [
        F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"), F.min("w").alias("least"), F.max("w").alias("most"),
        F.count_if(F.col("w") < 30).alias("short"), F.count_if(F.col("w").between(30, 100)).alias("medium"), F.count_if(F.col("w") > 100).alias("long"),
    ]
    # without keys there is a row for an empty table, too
    base = own.groupBy(key.alias("key")).agg(*aggregates) if keys else own.agg(*aggregates).select(key.alias("key"), "*")
    j = base.join(percentiles(own, keys or [], "w", {"median": 0.5}), "key", "left")
    return j.select(*[F.col("key")[k].alias(k) for k in keys or []], "n", "mean", "median", "least", "most", "short", "medium", "long")


def _grouped(df: DataFrame, key: Column) -> DataFrame:
    """Sizes of the groups of equal keys of two rows or more. Keys may be long
    texts, so rows are grouped by two hashes of them."""
    k = df.select(key.alias("k")).where("k <> ''").select(F.xxhash64("k").alias("a"), F.hash("k").alias("b"))
    return k.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


def duplicates(df: DataFrame, text: str) -> DataFrame:
    """Rows in groups of equal stripped texts, and such groups."""
    return _grouped(df, X.strip(F.coalesce(F.col(text), F.lit(""))))


def similar_starts(df: DataFrame, text: str, words: int = 12, least: int = 4) -> DataFrame:
    """Rows in groups of texts that share their first words, and groups."""
    t = df.where(X.word_count(F.col(text)) >= least)
    return _grouped(t, F.lower(X.first_words(F.col(text), words)))


def distinct_gaps(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Rows less distinct keys, per named key (exact).

    Rows are told apart by two hashes of 64 bits and a third one of 32 with the
    lengths; values of equal first two but different third hash are compared as
    they are. So values are not shuffled, but for such clashes.
    """
    cells = lambda cols: [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    size = lambda cols: sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in cols), F.lit(0))
    marks = F.array(*[F.struct(F.lit(n).alias("name"), F.xxhash64(*cells(cols)).alias("a"), F.xxhash64(F.lit(n), F.lit(7), *reversed(cells(cols))).alias("b"), F.struct(F.hash(*cells(cols)), size(cols)).alias("c")) for n, cols in keys.items()])
    groups = df.select(F.explode(marks).alias("m")).select("m.*").groupBy("name", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    more = dict.fromkeys(keys, 0)
    clash = groups.where("low <> high").select("name", "a", "b")
    for n in [r["name"] for r in clash.select("name").distinct().collect()]:
        own = df.select(*keys[n], F.xxhash64(*cells(keys[n])).alias("a"), F.xxhash64(F.lit(n), F.lit(7), *reversed(cells(keys[n]))).alias("b")).join(clash.where(F.col("name") == n), ["a", "b"], "left_semi")
        more[n] = own.distinct().count() - clash.where(F.col("name") == n).count()
    gap = lambda n: F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n") - 1)), F.lit(0)) - more[n]
    return groups.agg(*[gap(n).cast("long").alias(n) for n in keys])


def time_span(df: DataFrame, seconds: str) -> DataFrame:
    """First and last date of positive times (UTC), and the days between."""
    s = df.where(F.col(seconds) > 0).agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi"))
    return s.select(X.epoch_date(F.col("lo")).alias("first"), X.epoch_date(F.col("hi")).alias("last"), F.floor((F.col("hi") - F.col("lo")) / 86400).alias("days"))


def page_profile(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: pages, pages with text, images, tables, words, images, and
    the ratios. pages: keys, text, n_images. A ratio without base is null."""
    n = X.word_count(F.col("text"))
    t = pages.withColumn("w", n).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("w") > 0).alias("text_pages"), F.count_if(F.col("n_images") > 0).alias("image_pages"), F.count_if(X.has_caption(F.col("text"))).alias("table_pages"),
        F.sum("w").alias("words"), F.sum("n_images").alias("images"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"),
    )
    return page_ratios(t)


def page_ratios(totals: DataFrame) -> DataFrame:
    per = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return totals.withColumns({"coverage": per("text_pages", "n_pages"), "words_per_page": per("words", "text_pages"), "density": per("n_pages", "image_pages"), "chars_per_image": per("chars", "images")})


def profile_rollup(profiles: DataFrame, key: str, total: str = "GESAMT") -> DataFrame:
    """Ratios of sums per key and over all."""
    sums = ("n_pages", "text_pages", "image_pages", "table_pages", "words", "images", "chars")
    r = profiles.rollup(key).agg(F.grouping(key).alias("_all"), F.count(F.lit(1)).alias("n_docs"), *[F.sum(c).alias(c) for c in sums])
    return page_ratios(r.withColumn(key, F.when(F.col("_all") == 1, total).otherwise(F.col(key))).drop("_all"))


def mean_of_means(profiles: DataFrame) -> DataFrame:
    """The overall row of manuals: means of the documents' own means."""
    return profiles.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("words_per_page").alias("words_per_page"), F.avg("coverage").alias("coverage"))


def outline_profile(docs: DataFrame) -> DataFrame:
    """Per document: entries, depth, and a histogram of levels from 0."""
    o = F.coalesce("content.outline", F.array())
    levels = F.transform(o, lambda e: e["level"] - 1)
    return docs.select("source_type", "doc_id", F.size(o).alias("n_entries"), F.coalesce(F.array_max(levels) + 1, F.lit(0)).alias("depth"), levels.alias("_l")).select(
        "source_type", "doc_id", "n_entries", "depth", F.transform(F.when(F.col("depth") > 0, F.sequence(F.lit(0), F.col("depth") - 1)).otherwise(F.array().cast("array<int>")), lambda d: F.size(F.filter("_l", lambda x: x == d))).alias("entries_at_depth")
    )


def image_sizes(images: DataFrame) -> DataFrame:
    """Images per bucket of their longer side."""
    side = F.greatest("width", "height")
    bucket = F.when(side < 100, "<100").when(side < 300, "100-299").when(side < 800, "300-799").otherwise(">=800")
    return images.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_relevant_image(F.col("width"), F.col("height"))).alias("n_relevant"))


def images_per_page(images: DataFrame) -> DataFrame:
    return images.groupBy("page").agg(F.count(F.lit(1)).alias("n"))


#: Ranges that ``systematic_sample`` deals rows to.
RANGES = 64


def systematic_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every (rows // n)-th row in order, the first n of them, in order.

    The rows are dealt by ranges, whose bounds come from a sample. A row's
    number is its place in its range and the sizes of the ranges before, so no
    task numbers all rows.
    """
    total = df.count()
    if not total:
        return df.limit(0)
    row = lambda *cs: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cs)])
    drawn = df.select(*order).sample(min(1.0, 64 * RANGES / total), seed=42).sort(*order).collect()
    bounds = drawn[:: max(1, -(-len(drawn) // RANGES))][1:]
    at = sum((F.when(row(*map(F.col, order)) >= row(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, b, strict=True)]), 1).otherwise(0) for b in bounds), F.lit(0))
    ranged = df.withColumn("_range", at)
    before, seen = {}, 0
    for r in sorted(ranged.groupBy("_range").count().collect()):
        before[r["_range"]], seen = seen, seen + r["count"]
    start = F.element_at(F.create_map(*[F.lit(v) for r in before.items() for v in r]), F.col("_range"))
    numbered = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + start)
    step = max(1, total // n)
    return numbered.where((F.col("_i") % step == 0) & (F.col("_i") < n * step)).drop("_i", "_range").orderBy(*order)


def text_faults(df: DataFrame, text: str, subject: str | None = None) -> DataFrame:
    """Texts with broken encoding, and subjects that say nothing."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(X.has_mojibake(F.col(text))).alias("n_mojibake")]
    if subject:
        aggs.append(F.count_if(X.uninformative_subject(F.col(subject))).alias("n_uninformative"))
    return df.agg(*aggs)
