"""Source divergence audit: how the sources of a language differ in their terms.

First pass: each task counts, per language, in how many of its documents a term
is, and adds that to the cells of a count-min sketch; Spark sums the cells. A
cell is never less than the documents of a term that falls in it, so a term one
of whose cells stays below the least number of documents is impossible. The
cells that reach it are broadcast as bits, of a fixed number. Second pass: the
terms that are possible are counted exactly, per source; all others are held
back in the task and never shuffled.

The distance of two sources runs over all kept terms, most of which neither
has. With p0 the p of a term that a source doesn't have, the sum is V * |p0 -
q0| and what the terms that one of the two has change in it; that comes from
each source's counts of counts, and, for terms that both have, from a join of
the terms' sparse counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textmill.llm.bitset import broadcast_cells, held
from textmill.llm.common import prepare, stash

#: Documents of a kept term; ranks of part ``term``.
LEAST, RANKS = 30, 50
#: Rows of the sketch, and the bits of a row's cells (32 MB are broadcast).
DEPTH, BITS = 2, 27
#: Different terms that a task holds before it gives out their counts.
HELD = 500_000
#: Groups (language and source) whose figures are broadcast, 100 bytes each.
GROUPS = 100_000
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_NO_TERM = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_UPPER + _NO_TERM, _LOWER + b" " * len(_NO_TERM))


def terms(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TABLE).split() if raw else []


def cells(lang: bytes, words: list[bytes], bits: int) -> np.ndarray:
    """A row per row of the sketch, a column per term: the cells."""
    h = np.fromiter((xxh64_intdigest(lang + b"\0" + w) for w in words), np.uint64, len(words))
    low, high, mask = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32), np.uint64((1 << bits) - 1)
    return np.stack([((low + np.uint64(i) * high) & mask).astype(np.int64) + (i << bits) for i in range(DEPTH)])


def sketch(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """cell, n: the merged sketch. docs: lang, source, text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in seen.items():
                at = cells(lang, list(n), bits)
                for row in at:
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(list(n.values()), pa.int64())], names=["cell", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                seen[lang].update(set(terms(text)))
            if sum(map(len, seen.values())) >= HELD:
                yield from out()
                seen.clear()
        yield from out()

    return docs.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def possible(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> Broadcast:
    """The cells of the sketch that reach ``least``."""
    return broadcast_cells(sketch(docs, bits).where(F.col("n") >= least), DEPTH << bits)


def counted(docs: DataFrame, bound: Broadcast, bits: int = BITS) -> DataFrame:
    """lang, source, term, n (occurrences), docs of the possible terms; a row
    without a term for every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
        docs_of: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)

        def rows(lang: bytes, source: bytes, words: list, n: list, d: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.binary()), pa.array([source] * len(words), pa.binary()), pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in uses.items():
                words, d = list(n), docs_of[lang, source]
                ok = held(bound.value, cells(lang, words, bits)).all(axis=0) if words else ()
                words = [w for w, yes in zip(words, ok, strict=True) if yes]
                yield rows(lang, source, [None], [0], [0])
                for i in range(0, len(words), 1 << 16):
                    part = words[i : i + (1 << 16)]
                    yield rows(lang, source, part, [n[w] for w in part], [d[w] for w in part])

        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = terms(text)
                uses[lang, source].update(found)
                docs_of[lang, source].update(set(found))
            if sum(map(len, uses.values())) >= HELD:
                yield from out()
                uses.clear()
                docs_of.clear()
        yield from out()

    each = docs.mapInArrow(run, "lang binary, source binary, term binary, n bigint, docs bigint")
    return each.groupBy(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exactly, of columns."""
    wide = lambda x, digits: f"cast({x} AS decimal({digits},0))"
    return F.expr(f"1 + {wide(1_000_000_000, 10)} * {wide(f'{count} + 5', 19)} div greatest({wide(1, 20)}, {wide(total, 19)} + {wide(f'5 * {kept}', 19)})")


def _known(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """rows with their group's figures, by broadcast while those are few."""
    return rows.join(F.broadcast(groups) if groups.count() <= GROUPS else groups, [*keys])


def facts(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms). groups: lang, source, kept (terms of the language), p0
    (p of a term that the group doesn't have), for every group; terms: lang,
    source, term, p, p0, q (the language's p) of the kept terms that a group
    has. docs: lang, source, text."""
    prepare(docs.sparkSession)
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    each = stash(counted(base, possible(base, least, bits), bits), "terms")
    kept = each.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = stash(kept.drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("lang_total"))
    own = each.where(F.col("n") > 0).join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all")
    zero = F.lit(0).cast("long")
    groups = each.where(F.col("term").isNull()).select("lang", "source").join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")]).withColumn("none", zero)
    groups = stash(groups.withColumn("p0", _p("none", "total", "kept")).drop("none"), "groups")
    known = _known(own, groups, "lang", "source").withColumn("p", _p("n", "total", "kept")).withColumn("q", _p("all", "lang_total", "kept"))
    return groups.select("lang", "source", "kept", "p0"), stash(known.select("lang", "source", "term", "p", "p0", "q"), "facts")


def distances(groups: DataFrame, terms_of: DataFrame) -> DataFrame:
    """lang, source, item, value: both directions of every pair of sources."""
    a = groups.select("lang", "source", "kept", "p0")
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    pairs = a.join(b, "lang").where(F.col("source") != F.col("item"))
    apart = F.abs(F.col("p0") - F.col("o0"))
    neither = pairs.where(F.col("source") < F.col("item")).select("lang", F.col("source").alias("x"), F.col("item").alias("y"), (F.col("kept") * apart).alias("v"))
    # p depends on the count alone, so a source's terms are few different p
    hist = terms_of.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    one = pairs.join(hist, ["lang", "source"]).groupBy("lang", F.least("source", "item").alias("x"), F.greatest("source", "item").alias("y")).agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("o0")) - apart)).alias("v"))
    other = terms_of.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    shared = F.abs(F.col("p") - F.col("o")) - F.abs(F.col("p") - F.col("o0")) - F.abs(F.col("o") - F.col("p0")) + apart
    both = terms_of.select("lang", "term", "source", "p", "p0").join(other, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", F.col("source").alias("x"), F.col("item").alias("y")).agg(F.sum(shared).alias("v"))
    value = neither.unionByName(one).unionByName(both).groupBy("lang", "x", "y").agg(F.sum("v").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    return value.select("lang", sides.alias("s"), "value").select("lang", "s.source", "s.item", "value")


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """lang, source, part, item, value, rank: for every group of a language and
    source, how far it is from each other source (``pair``), and the terms it
    has more of than the language (``term``).

    Null languages, sources and texts are empty ones. A group without terms,
    or of a language without kept terms, has its pairs still, and no terms; a
    source alone in its language has no pairs. Very long texts are counted
    whole; bytes that are no UTF-8 are parts of terms. Repeated rows are
    documents each; ties are broken by item. An empty table gives an empty
    result. Columns other than these three are not looked at.
    """
    groups, terms_of = facts(docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), least, bits)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(order)
    pairs = distances(groups, terms_of).withColumn("rank", rank)
    over = terms_of.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", rank).where(F.col("rank") <= ranks)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return part(pairs, "pair").unionByName(part(over, "term"))
