"""Benchmark decontamination, in DataFrame functions only.

Each benchmark window is keyed by the hash of one pair of neighbouring words of
it, its anchor: the longest pair, which is the most telling. The pairs of a
training text are hashed once and looked up in the broadcast set of anchors
(of a set of more than ``ANCHORS``, in as many passes over the texts as there
are parts of it). A word pair that is met takes the few words around it to the
windows of its anchor, where the whole window is compared word by word. Every
occurrence of a window contains its anchor, so none is missed. No text is
shuffled, only met pairs with their words; the windows are broadcast up to
``WINDOWS`` of them, else met by a shuffle join.

What items a window is in is kept once for each different set of items; a text
carries the sets' hashes, and each different collection of sets is resolved to
item ids once, however many texts have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import stash, with_key_rows

N = 13
#: Anchors that a pass broadcasts (about 32 bytes each), and benchmark windows
#: that may be broadcast (about 0.2 KB each).
ANCHORS, WINDOWS = 2_000_000, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _lower(w: Column) -> Column:
    """A-Z to a-z alone; ``lower`` is the quick form for ASCII words."""
    return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ ; null: none.

    A-Z are split as word characters. An ASCII text is lower-cased at once,
    another one per word.
    """
    t = F.coalesce(text, F.lit(""))
    split = lambda x: F.array_remove(F.split(x, _BETWEEN), "")
    return F.when(F.octet_length(t) == F.char_length(t), split(F.lower(t))).otherwise(F.transform(split(t), _lower))


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")).cast("long")


def _once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """Computes a column once: a generator keeps the optimizer from copying
    the expression into the lambdas that read it, where it would run per
    element."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = N) -> tuple[DataFrame, DataFrame]:
    """(windows, sets). windows: gram, h, off, set: the different windows with
    the hash and place of their anchor (of a single word: the word) and the
    set of items they are in. sets: set and item, a row for each item of a
    set, as text."""
    b = _once(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")), "w", words(F.col("text")), "item")
    b = b.where(F.size("w") > 0).select("item", "w", F.least(F.lit(n), F.size("w")).alias("size"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1)))).alias("at"))
    b = _once(b, "gram", F.slice("w", F.col("at"), F.col("size")), "item").groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    follow = lambda i: F.coalesce(F.get("gram", i + 1), F.lit(""))
    heads = F.slice("gram", 1, F.greatest(F.lit(1), F.size("gram") - 1))
    anchor = F.array_max(F.transform(heads, lambda w, i: F.struct((F.length(w) + F.length(follow(i))).alias("n"), w.alias("w"), follow(i).alias("v"), i.alias("i"))))
    b = _once(b, "a", anchor, "gram", "items").select("gram", "items", F.xxhash64("a.w", "a.v").alias("h"), F.col("a.i").alias("off"))
    b = stash(b.withColumn("set", F.sha2(F.to_json("items"), 256)), "windows")
    return b.drop("items"), b.dropDuplicates(["set"]).select("set", F.explode("items").alias("item"))


def _met(w: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """doc_id, key, place, start, around, h: the word pairs (of windows of a
    single word: the words) that are anchors, with the words around them from
    ``start`` on. w: doc_id, key, w."""
    known = windows.agg(F.countDistinct("h").alias("anchors"), F.count_if(F.size("gram") == 1).alias("single")).first()
    keys = F.transform("w", lambda x, i: F.xxhash64(x, F.coalesce(F.get("w", i + 1), F.lit(""))))
    if known["single"]:
        keys = F.concat(keys, F.transform("w", lambda x: F.xxhash64(x, F.lit(""))))
    # exploding a plain column is compiled, and the words beside it are a reference; exploding an expression would copy them per word
    each = _once(w, "keys", keys, "doc_id", "key", "w").select("doc_id", "key", "w", F.posexplode("keys").alias("place", "h"))
    if known["single"]:
        each = each.withColumn("place", F.col("place") % F.size("w"))
    passes = max(1, -(-known["anchors"] // ANCHORS))
    part = lambda df, i: df if passes == 1 else df.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == i)
    met = None
    for i in range(passes):
        own = part(each, i).join(F.broadcast(part(windows.select("h").distinct(), i)), "h", "left_semi")
        met = own if met is None else met.unionByName(own)
    start = F.greatest(F.lit(0), F.col("place") - (n - 2))
    return met.select("doc_id", "key", "h", "place", start.alias("start"), F.slice("w", start + 1, F.col("place") - start + n).alias("around"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, found, sets): rows has id, key (hash of the text) and n_words of
    every row; found has, per id and key, the spans (first word, words) and the
    sorted sets of items of the windows that occur in the text; sets has the
    items of each set."""
    windows, sets = benchmark_windows(benchmark, n=n)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = base.select("doc_id", F.xxhash64("text").alias("key"), n_words(F.col("text")).alias("n_words"))
    w = _once(base.where(F.col("text").isNotNull()).withColumn("key", F.xxhash64("text")), "w", words(F.col("text")), "doc_id", "key")
    few = windows.count() <= WINDOWS
    met = _met(w, windows, n).join(F.broadcast(windows) if few else windows, "h")
    at = F.col("place") - F.col("off")
    found = met.where((at >= 0) & (F.slice("around", at - F.col("start") + 1, F.size("gram")) == F.col("gram")))
    found = found.select("doc_id", "key", F.struct(at.alias("at"), F.size("gram").alias("size")).alias("span"), "set")
    return rows, found.groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("set")).alias("sets")), sets


def covered(spans: str) -> Column:
    """Words inside any span: a fold over the spans in order of position."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["at"] + s["size"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(acc["end"], s["at"]))).cast("long").alias("n"),
        ),
    )
    return fold["n"]


def _counted(rows: DataFrame, found: DataFrame, *more: str) -> DataFrame:
    """doc_id, key, n_words, n_hit, contaminated per row, and more columns of
    found."""
    found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), covered("spans").alias("hit"), *more)
    j = rows.join(found, rows.doc_id.eqNullSafe(found["_id"]) & rows.key.eqNullSafe(found["_key"]), "left")
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return j.select("doc_id", "key", "n_words", hit.alias("n_hit"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), *more)


def _with_items(found: DataFrame, sets: DataFrame) -> DataFrame:
    """found with n_items and ids (the sorted items, joined)."""
    found = stash(found.withColumn("which", F.sha2(F.concat_ws(",", "sets"), 256)), "found")
    kinds = found.groupBy("which").agg(F.count(F.lit(1)).alias("n"), F.first("sets").alias("sets"))
    items = kinds.select("which", "n", F.explode("sets").alias("set")).join(sets, "set").groupBy("which").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("item")).alias("items"))
    items = items.select("which", "n", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    none = kinds.join(items.select("which"), "which", "left_anti").select("which", "n", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))  # items without an id
    return with_key_rows(found, ["which"], items.unionByName(none), found.count())


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null, empty and wordless texts have no words and are clean, with the hash
    of the empty string. Items without words have no window; an empty
    benchmark leaves every text clean, an empty table of documents gives an
    empty result. Very long texts are read whole. Malformed UTF-8 is word
    characters. Repeated rows give equal rows; rows of one id with different
    texts are kept apart by the texts' hashes. Other columns are not looked at.
    """
    rows, found, sets = hits(docs, benchmark, id_col, text_col, n)
    j = _counted(rows, _with_items(found, sets), "n_items", "items_sha256")
    return j.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), "contaminated")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    Null, empty and wordless texts stay, as does every text where there is no
    benchmark; repeated rows go or stay together; an empty table stays empty.
    """
    rows, found, _ = hits(docs, benchmark, id_col, text_col, n)
    bad = _counted(rows, found).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(bad["_key"]), "left_anti")


def _runs(spans: str) -> Column:
    """The spans as sorted runs of words (from, to), touching ones as one."""
    empty = F.array().cast("array<struct<a:int,b:int>>")
    run = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def step(acc: Column, s: Column) -> Column:
        end, last = s["at"] + s["size"], F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(run(last["a"], F.greatest(last["b"], end))))
        return F.when((F.size(acc) > 0) & (s["at"] <= last["b"]), joined).otherwise(F.concat(acc, F.array(run(s["at"], end))))

    return F.aggregate(F.array_sort(spans), empty, step)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """doc_id, text: the hit words cut from each text (with what stands
    between two cut words), every other character kept.

    A text is what stands before its first word, that word, what stands
    between it and the next, and so on; what is kept are the stretches of that
    between the runs of hit words, each copied once. Null, empty and wordless
    texts, and all texts where there is no benchmark, stay as they are; very
    long texts are cut whole; malformed UTF-8 of a text that is cut becomes
    U+FFFD; repeated rows give equal rows; an empty table stays empty.
    """
    _, found, _ = hits(docs, benchmark, id_col, text_col, n)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    f = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), _runs("spans").alias("cut"))
    j = base.join(f, base.doc_id.eqNullSafe(f["_id"]) & base.key.eqNullSafe(f["_key"]), "left").select("doc_id", "text", "cut")
    word = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    parts = F.arrays_zip(F.split("text", word, -1).alias("gap"), F.regexp_extract_all("text", F.lit(f"({word})"), F.lit(1)).alias("word"))
    flat = F.flatten(F.transform(parts, lambda p: F.array(p["gap"], F.coalesce(p["word"], F.lit("")))))
    cut = _once(j.where("cut IS NOT NULL"), "flat", flat, "doc_id", "cut")
    starts = F.concat(F.array(F.lit(0)), F.transform("cut", lambda r: 2 * r["b"]))
    ends = F.concat(F.transform("cut", lambda r: 2 * r["a"] + 1), F.array(F.size("flat")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("flat", a + 1, b - a)))
    return j.where("cut IS NULL").select("doc_id", "text").unionByName(cut.select("doc_id", F.array_join(kept, "").alias("text")))
