"""Phrase collocations by generalised suffix automata.

Each task cuts its texts into pieces of words and builds, per language, the
generalised suffix automaton of a shard of them, unfolded to the depth of the
longest phrase: ``Automaton`` numbers the different substrings of each length
and knows how many positions each ends at (endpos) and its suffix link, the
substring without its first word. Spark sums the counts over all shards.

A phrase can be frequent only if its parts are. Words are counted first, then
pairs and triples by a hash alone, which holds back nearly all rare ones in few
bytes; the last pass counts the phrases of 2 to 5 words that the sets of
frequent hashes, or for 4 and 5 words those of their parts, let through. The
sets are bits of a fixed number, broadcast; at any size they hold back none
that is frequent, and what they let through is counted exactly.

Of the global counts a phrase is dropped if it is the suffix link, or the
beginning, of a frequent phrase of equal count: any longer phrase around it of
that count has one between them that is longer by one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textmill.llm.bitset import broadcast_cells, cell_of, held
from textmill.llm.common import prepare, stash, with_key_rows

#: Words of the longest phrase, its least count, phrases reported a language.
MOST, LEAST, TOP = 5, 100, 2000
#: Words of a shard (a longer text is a shard by itself), the bits of a set of
#: frequent phrases (8 MB), and those of the hash by which phrases are counted.
SHARD, BITS, HASH_BITS = 1 << 20, 26, 40
#: Into how many parts a language's phrases are dealt to be ranked first.
PARTS = 16
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _BREAKS, _LOWER + b"\n" * len(_BREAKS))


def words_and_breaks(raw: bytes) -> list[bytes]:
    """Lower-cased words; ``.``, which no word holds, where a piece ends."""
    return raw.translate(_TABLE).replace(b"\n", b" . ").split()


class Automaton:
    """The generalised suffix automaton of pieces of words, to a depth.

    words: the different words; ids: the pieces' word numbers, -1 between
    them. Of depth d, ``states[d]`` has the number of the substring of d words
    that ends at each position (-1: none), and per number ``ends[d]`` counts
    its positions, ``link[d]`` is its suffix link, ``at[d]`` one position,
    ``hashes[d]`` a hash that is the same in every shard, and ``alive[d]``
    whether it may be frequent.
    """

    def __init__(self, words: list[bytes], ids: np.ndarray, lang: bytes) -> None:
        self.words = words
        hashes = np.fromiter((xxh64_intdigest(lang + b"\0" + w) for w in words), np.uint64, len(words))
        at = np.zeros(len(words), np.int64)
        at[ids[ids >= 0]] = np.flatnonzero(ids >= 0)
        self.states, self.at, self.hashes, self.alive = {1: ids}, {1: at}, {1: hashes}, {1: np.ones(len(words), bool)}
        self.ends, self.link = {1: np.bincount(ids[ids >= 0], minlength=len(words))}, {1: np.full(len(words), -1)}

    def hold(self, bits: np.ndarray, n: int) -> None:
        """Keeps alive only those deepest substrings that a set has."""
        d = max(self.states)
        self.alive[d] = held(bits, cell_of(self.hashes[d], n))

    def grow(self) -> None:
        """One word deeper, of substrings whose two halves, the one without
        the last and the one without the first word, are alive."""
        d = max(self.states)
        was = np.where((self.states[d] >= 0) & self.alive[d][self.states[d]], self.states[d], -1) if len(self.at[d]) else self.states[d]
        here = np.flatnonzero((was[:-1] >= 0) & (was[1:] >= 0)) + 1 if len(was) else np.zeros(0, np.int64)
        last = self.states[1][here].astype(np.int64)
        keys = was[here - 1].astype(np.int64) * len(self.words) + last
        codes, found = pd.factorize(keys)
        state = np.full(len(was), -1, np.int64)
        state[here] = codes
        at = np.zeros(len(found), np.int64)
        at[codes] = here
        mixed = self.hashes[d][found // max(1, len(self.words))] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[1][found % max(1, len(self.words))]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.states[d + 1], self.at[d + 1], self.hashes[d + 1] = state, at, mixed ^ (mixed >> np.uint64(32))
        self.ends[d + 1], self.link[d + 1], self.alive[d + 1] = np.bincount(codes, minlength=len(found)), was[at], np.ones(len(found), bool)

    def phrases(self, d: int, states: np.ndarray) -> pa.Array:
        words = pa.array(self.words, pa.binary())
        place = self.at[d][states]
        return pc.binary_join_element_wise(*[words.take(pa.array(self.states[1][place - k])) for k in range(d - 1, -1, -1)], pa.scalar(b" ", pa.binary()))


class _Numbers(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_COUNTS = "lang binary, phrase binary, size int, cell bigint, n bigint"
_NAMES = ["lang", "phrase", "size", "cell", "n"]


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bytes, list[bytes], np.ndarray]]:
    """(lang, words, ids) of shards of about ``most`` words."""
    seen: dict[bytes, _Numbers] = {}
    parts: dict[bytes, list[np.ndarray]] = {}
    held_words = 0

    def all_parts() -> Iterator[tuple[bytes, list[bytes], np.ndarray]]:
        for lang, own in parts.items():
            yield lang, list(seen[lang])[1:], np.concatenate(own) - 1  # the break's number is 0

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = words_and_breaks(text or b"")
            if not words:
                continue
            if lang not in seen:
                seen[lang], parts[lang] = _Numbers({b".": 0}), [np.zeros(1, np.int32)]
            parts[lang] += [np.fromiter(map(seen[lang].__getitem__, words), np.int32, len(words)), parts[lang][0]]
            held_words += len(words)
            if held_words >= most:
                yield from all_parts()
                seen, parts, held_words = {}, {}, 0
    yield from all_parts()


def _automata(batches: Iterator[pa.RecordBatch], depth: int, sets: dict[int, Broadcast], shard: int, bits: int) -> Iterator[tuple[bytes, Automaton]]:
    """The automata of the shards, ``depth`` words deep. sets: of some lengths,
    the frequent phrases; no other one of these lengths is alive."""
    for lang, words, ids in _shards(batches, shard):
        a = Automaton(words, ids, lang)
        for d in range(1, depth + 1):
            if d > 1:
                a.grow()
            if d in sets:
                a.hold(sets[d].value, bits)
        yield lang, a


def hash_counts(docs: DataFrame, depth: int, sets: dict[int, Broadcast], shard: int = SHARD, bits: int = BITS) -> DataFrame:
    """cell, n: occurrences of phrases of ``depth`` words, by the hash alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a in _automata(batches, depth, sets, shard, bits):
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(a.hashes[depth], HASH_BITS)), pa.array(a.ends[depth], pa.int64())], names=["cell", "n"])

    return docs.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, low: int, high: int, sets: dict[int, Broadcast], shard: int = SHARD, bits: int = BITS) -> DataFrame:
    """lang, phrase, size, cell of the phrase's hash, n of the phrases of low
    to high words that may be frequent, summed over all shards. docs: lang,
    text (binary). With low 1, a row without a phrase has a language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, a in _automata(batches, high, sets, shard, bits):
            row = lambda *cols: pa.RecordBatch.from_arrays(list(cols), names=_NAMES)
            if low == 1:
                yield row(pa.array([lang], pa.binary()), pa.array([None], pa.binary()), *(pa.array([x], t) for x, t in ((0, pa.int32()), (0, pa.int64()), (int(a.ends[1].sum()), pa.int64()))))
            for d in range(low, high + 1):
                states = np.flatnonzero(a.alive[d])
                for i in range(0, len(states), 1 << 16):
                    s = states[i : i + (1 << 16)]
                    yield row(pa.array([lang] * len(s), pa.binary()), a.phrases(d, s), pa.array(np.full(len(s), d), pa.int32()), pa.array(cell_of(a.hashes[d][s], bits)), pa.array(a.ends[d][s], pa.int64()))

    each = docs.mapInArrow(run, _COUNTS).select(*[F.col(c).cast("string").alias(c) for c in ("lang", "phrase")], "size", "cell", "n")
    return each.groupBy("lang", "phrase", "size", "cell").agg(F.sum("n").alias("n"))


def _index(phrase: str, words: Column) -> Column:
    """The first so many words, or, of a negative number, the last."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), words.cast("int"))


def frequent(docs: DataFrame, least: int = LEAST, most: int = MOST, shard: int = SHARD, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(counts, totals). counts: lang, phrase, size (1 to ``most`` words), n of
    all phrases that occur ``least`` times or more; totals: lang and its words.
    docs: lang and text, as text."""
    prepare(docs.sparkSession)
    base = docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))
    words = stash(phrase_counts(base, 1, 1, {}, shard, bits).where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    totals = words.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("total"))
    words = words.where(F.col("phrase").isNotNull())
    sets = {1: broadcast_cells(words.select("cell"), 1 << bits)}
    for depth in (2, 3):
        cells = hash_counts(base, depth, sets, shard, bits).where(F.col("n") >= least)
        sets[depth] = broadcast_cells(cells.select(F.shiftright("cell", HASH_BITS - bits).alias("cell")), 1 << bits)
    phrases = stash(phrase_counts(base, 2, most, sets, shard, bits).where(F.col("n") >= least), "phrases")
    return words.drop("cell").unionByName(phrases.drop("cell")), totals


def maximal(counts: DataFrame) -> DataFrame:
    """The phrases of two words or more that no longer one of equal count
    holds."""
    longer = counts.where(F.col("size") > 2)
    link = _index("phrase", 1 - F.col("size"))
    head = _index("phrase", F.col("size") - 1)
    inside = longer.select("lang", F.explode(F.array(link, head)).alias("phrase"), "n")
    return counts.where(F.col("size") > 1).join(inside, ["lang", "phrase", "n"], "left_anti")


def _looked_up(rows: DataFrame, part: str, counts: DataFrame, name: str, total: int) -> DataFrame:
    """rows with the count of their part; frequent parts are joined apart."""
    values = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    asked = rows.groupBy("lang", part).agg(F.count(F.lit(1)).alias("n"))
    return with_key_rows(rows, ["lang", part], asked.join(values, ["lang", part]), total).drop("n")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the maximal phrases, by their
    lowest-scoring cut."""
    k = F.col("k")
    cuts = maximal(counts).select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = stash(cuts.select("lang", "phrase", "a", "k", _index("phrase", k).alias("left"), _index("phrase", k - F.col("size")).alias("right")), "cuts")
    rows = cuts.count()
    both = _looked_up(_looked_up(cuts, "left", counts, "l", rows), "right", counts, "r", rows)
    # exact: 1000 a n and l r as decimals of 38 digits
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    per = cuts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(totals, "lang")
    both = with_key_rows(both, ["lang"], per, rows).drop("n").withColumnRenamed("total", "n")
    both = both.withColumn("up", wide(F.col("a") * 1000, 19) * wide(F.col("n"), 18)).withColumn("down", wide(F.col("l"), 18) * wide(F.col("r"), 18))
    lowest = both.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m"))
    return lowest.select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", shard: int = SHARD, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``.

    A null language is ``und``; null, empty and wordless texts have no words;
    very long texts are counted whole; bytes that are no UTF-8 are parts of
    words. Repeated rows count each; ties are broken by count and phrase. An
    empty table, or one without frequent phrases, gives no row. Columns other
    than the language and text are not looked at.
    """
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts, totals = frequent(own, least, shard=shard, bits=bits)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = scored(counts, totals).withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
