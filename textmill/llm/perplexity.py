"""Interpolated modified Kneser-Ney word model as a quality classifier.

Trusted texts (two thirds of all rows labelled as good) are counted as 1- to
3-grams. Counts travel and lie in packed columns: a row holds a shard's keys
in order, as steps, and their small counts. Triples meet first by the pair that
ends them, which gives the continuation counts, then by the pair that starts
them, which gives what a history leaves; a pair has one shard for both. So a
shard has all that the interpolated modified Kneser-Ney estimate needs of its
pairs and triples, but for the few numbers per word that are broadcast.

The log-probability of a text is a sum over its words, of what a word has after
an unseen history, and of a correction for each pair and each triple of words
that the model knows. The most frequent grams are broadcast and added where the
text is; of the others, those that a Bloom filter lets through are shuffled, as
packed (row, gram, count), to the shards, which lie in buckets and are not
shuffled. No text is shuffled to be judged.

A document's perplexity is compared with a quantile, of its language, of all
trusted texts that the model has not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import by_value, free_shuffles, fresh, one_text, passing_tables, prepare, rows_of, stash, unit_of

#: Where a caller asks for a sample (no query does): trusted rows, in
#: expectation, of all languages by their shares, and of each language at
#: least, of which two thirds train. And words of the vocabulary.
TRUSTED_ROWS, LANGUAGE_ROWS, VOCABULARY = 6000, 600, 1 << 20
#: A text is rejected beyond this quantile of its language's unseen trusted
#: texts plus ``SLACK`` times its distance from their median.
QUANTILE, SLACK = 0.99, 0.5
#: Pseudo tokens at the language's median, for short texts.
PRIOR = 20
#: Languages with a threshold of their own need so many unseen trusted texts.
LEAST_TEXTS = 30
#: Grams that are broadcast, the most frequent; bits of the Bloom filter per
#: other gram, and at most (a fuller filter lets more through, and loses none).
HEAD_GRAMS, BITS_A_GRAM, MOST_BITS = 1_000_000, 12, 1 << 28
UNKNOWN, START, END, FIRST = 0, 1, 2, 3
_BITS = 21
_LOW = (1 << _BITS) - 1
#: Words worked on at once, and how many times that a task gathers before it
#: sends packed grams.
CHUNK, GATHERED = 1 << 18, 4
#: Shards of the model: at least, and one more for so many words of its texts.
LEAST_SHARDS, SHARD_WORDS = 8, 1 << 20


def words(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []


def encode(ids: dict[bytes, int], ws: list[bytes]) -> np.ndarray:
    get = ids.get
    return np.array([START, START, *[get(w, UNKNOWN) for w in ws], END], np.int64)


def pairs_of(x: np.ndarray) -> np.ndarray:
    """Keys of the pairs of neighbouring words: below zero."""
    return ~((x[:-1] << _BITS) | x[1:])


def triples_of(x: np.ndarray) -> np.ndarray:
    return (x[:-2] << (2 * _BITS)) | (x[1:-1] << _BITS) | x[2:]


def discounts(c: dict[int, int]) -> list[float]:
    """D(0) = 0, D(1), D(2), D(3+) from the counts of counts."""
    n = [float(c.get(i, 0)) for i in range(5)]
    if not (n[1] and n[2]):
        return [0.0, 0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
    # above zero: a history of repeated grams alone must leave some weight to others
    return [0.0] + [min(max(x, 0.1), float(i)) for i, x in enumerate(d, 1)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed unsigned hashes of keys."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair (packed, not below zero)."""
    return (mixed(pairs) % np.uint64(shards)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, byte by byte of their places and compressed:
    most counts are small, and most high bytes alike."""
    planes = [np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T for c in columns]
    return pa.compress(np.concatenate(planes).tobytes(), "zstd", asbytes=True)


def unpack(blobs: pa.ChunkedArray, sizes: pa.ChunkedArray, columns: int) -> list[np.ndarray]:
    """The columns of all the blobs, one blob after the other."""
    parts = []
    for blob, n in zip(blobs, sizes.to_pylist(), strict=True):
        raw = np.frombuffer(pa.decompress(blob.as_buffer(), 8 * columns * n, "zstd"), np.uint8)
        parts.append(np.ascontiguousarray(raw.reshape(columns, 8, n).transpose(0, 2, 1)).view("<i8")[:, :, 0])
    return list(np.concatenate(parts, 1)) if parts else [np.empty(0, np.int64)] * columns


def _runs(order: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts."""
    return np.flatnonzero(np.append(True, order[1:] != order[:-1])[: len(order)])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = _runs(keys)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


#: A row of packed columns: its shard (or block of words), what it holds, how many entries.
_ROW = "shard int, kind int, size int, blob binary"
#: Triples: steps between keys, n and m. Pairs: steps, m and n, of those that
#: end a text or whose m is not 1. Words: five counts each of a block's words.
#: Totals: counts of counts, and of steps.
TRIPLES, PAIRS, WORDS, TOTALS = range(4)
_BLOCK, _STEPS = 1 << 16, 256


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    shard, kind, size, blob = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.table([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(size, pa.int32()), pa.array(blob, pa.binary())], names=["shard", "kind", "size", "blob"])


def _dealt(shard: np.ndarray, kind: int, keys: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """A row for each shard of the keys, which are in order."""
    order = np.argsort(shard, kind="stable")
    first = _runs(shard[order])
    return [(int(shard[at[0]]), kind, len(at), pack(np.diff(keys[at], prepend=0), *(c[at] for c in columns))) for at in np.split(order, first[1:]) if len(at)]


def _keys(steps: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The keys again, from the steps of each row."""
    return np.concatenate([np.cumsum(x) for x in np.split(steps, np.cumsum(sizes)[:-1])]) if sizes else steps


def _read(rows: pa.Table, kind: int, columns: int) -> list[np.ndarray]:
    rows = rows.filter(pa.compute.equal(rows["kind"], kind))
    steps, *others = unpack(rows["blob"], rows["size"], columns)
    return [_keys(steps, rows["size"].to_pylist()), *others]


def step_of(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(4 * np.log2(n)).astype(np.int64), _STEPS - 1)


def merged(rows: pa.Table, shards: int, n_words: int) -> pa.Table:
    """The triples of one shard, dealt by the pair that ends them, summed; with
    each, m: how much that pair counts (by the different words before it; a
    pair that starts a text has none, so by how often it is there). Triples are
    dealt anew, by the pair that starts them."""
    k, n = summed(*_read(rows, TRIPLES, 2))
    ends = k & ((1 << 2 * _BITS) - 1)
    order = np.argsort(ends, kind="stable")
    first = _runs(ends[order])
    pair, size = ends[order][first], np.diff(np.append(first, len(k)))
    times = np.add.reduceat(n[order], first) if len(k) else n
    m = np.where(pair >> _BITS == START, times, size)
    of_triple = np.empty_like(k)
    of_triple[order] = np.repeat(m, size)
    b, c = pair >> _BITS, pair & _LOW
    told = (m != 1) | (c == END)  # the others are known as what starts a triple
    out = _dealt(shard_of(k >> _BITS, shards), TRIPLES, k, n, of_triple) + _dealt(shard_of(pair[told], shards), PAIRS, pair[told], m[told], times[told])
    blocks = -(-n_words // _BLOCK)
    count = lambda at, w=None: np.bincount(at, w, blocks * _BLOCK).astype(np.int64)
    words_ = np.stack([count(c), count(b, m), *(count(b[np.minimum(m, 3) == i]) for i in (1, 2, 3))])
    out += [(i, WORDS, _BLOCK, pack(*x)) for i, x in enumerate(np.split(words_, blocks, 1)) if x.any()]
    totals = [np.bincount(np.minimum(x, 5), minlength=_STEPS) for x in (n, m)]
    totals.append(np.bincount(step_of(n), minlength=_STEPS) + 2 * np.bincount(step_of(times), minlength=_STEPS))
    return _rows([*out, (0, TOTALS, _STEPS, pack(*totals))])


def _added(rows: pa.Table) -> pa.Table:
    """The sum of rows of one block of words, or of totals."""
    kind, size, columns = rows["kind"][0].as_py(), rows["size"][0].as_py(), 5 if rows["kind"][0].as_py() == WORDS else 3
    total = sum(np.stack(unpack(rows["blob"].slice(i, 1), rows["size"].slice(i, 1), columns)) for i in range(len(rows)))
    return _rows([(rows["shard"][0].as_py(), kind, size, pack(*total))])


def counts_of(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """What one shard counts: triples in order, n and m, where a pair that
    starts some begins and how often it is there; pairs in order, the places
    there of those that were told and of those that start triples, the m of
    the former, and how often each is there."""
    k, n, m = _read(rows, TRIPLES, 3)
    order = np.argsort(k)
    k, n, m = k[order], n[order], m[order]
    first = _runs(k >> _BITS)
    total = np.add.reduceat(n, first) if len(k) else n
    pair, told, times = _read(rows, PAIRS, 3)
    pairs, at = np.unique(np.concatenate([pair, (k >> _BITS)[first]]), return_inverse=True)
    often = np.zeros(len(pairs), np.int64)
    often[at[: len(pair)]], often[at[len(pair) :]] = times, total
    return k, n, m, first, total, pairs, at, told, often


class Words:
    """The words by number, from ``FIRST``, as one text; the numbers by word
    are made where they are asked for."""

    def __init__(self, words_: pa.ChunkedArray):
        size = len(words_)
        joined = pa.compute.binary_join(pa.ListArray.from_arrays([0, size], words_.combine_chunks()), b"\n")  # a word has no white space
        self.n, text = size, joined[0].as_buffer()
        self.size, self.packed = text.size, pa.compress(text, "zstd", asbytes=True)

    @cached_property
    def ids(self) -> dict[bytes, int]:
        text = pa.decompress(self.packed, self.size, "zstd", asbytes=True)
        return {w: FIRST + i for i, w in enumerate(text.split(b"\n"))} if self.n else {}


class Weights:
    """What makes corrections of counts: by word p (log10 as a last resort), h
    (log10 of what it leaves, as a history, to other words) and s (how much it
    counts as a history), and the discounts of pairs and triples. It travels as
    the counts that it is made of, which pack well."""

    def __init__(self, one: np.ndarray, d2: np.ndarray, d3: np.ndarray):
        """one: by word, its different words before it, its sum as a history,
        and the pairs it starts that count 1, 2 and more."""
        self.packed, self.n_words, self.d2, self.d3 = [pack(x) for x in one], one.shape[1], d2, d3
        n, size = one[0], one.shape[1] - FIRST + 2
        d1 = np.array(discounts(dict(enumerate(np.bincount(np.minimum(n[n > 0], 5), minlength=6).tolist()))))[np.minimum(n, 3)]
        total = int(n.sum())
        spare = float(d1.sum()) / total / size if total else 1 / size
        self.p = np.log10((n - d1) / float(total or 1) + spare)
        self.s, self.h = one[1].astype(np.float64), np.zeros(one.shape[1])
        self.h[self.s > 0] = np.log10((d2[1:] @ one[2:])[self.s > 0] / self.s[self.s > 0])

    def __reduce__(self):
        return _weights, (self.packed, self.n_words, self.d2, self.d3)

    def pair(self, pairs: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of the pairs' last words: by the pair, and without it."""
        b = pairs >> _BITS
        low = self.h[b] + self.p[pairs & _LOW]
        return np.log10((m - self.d2[np.minimum(m, 3)]) / self.s[b] + 10**low), low

    def of(self, rows: pa.Table) -> tuple[np.ndarray, ...]:
        """(triples, corrections, n, pairs, corrections, n) of one shard, the
        keys in order. A pair's correction is that of its last word and, as the
        history of the next one, of what it leaves."""
        k, n, m, first, total, pairs, at, told, often = counts_of(rows)
        each = np.diff(np.append(first, len(k)))
        d = self.d3[np.minimum(n, 3)]
        h3 = np.log10((np.add.reduceat(d, first) if len(k) else d) / total)
        p2, _ = self.pair(k & ((1 << 2 * _BITS) - 1), m)
        backed = np.repeat(h3, each) + p2
        w = np.log10((n - d) / np.repeat(total, each) + 10**backed) - backed
        m, v = np.ones(len(pairs), np.int64), np.zeros(len(pairs))
        m[at[: len(told)]] = told
        ends = np.flatnonzero(pairs & _LOW != START)  # nothing ends with two starts
        p2, low = self.pair(pairs[ends], m[ends])
        v[ends] = p2 - low
        v[at[len(told) :]] += h3
        return k, w, n, pairs, v, often


def _weights(packed: list[bytes], n_words: int, d2: np.ndarray, d3: np.ndarray) -> Weights:
    one = np.empty((len(packed), n_words), np.int64)
    for i, x in enumerate(packed):
        one[i] = unpack(pa.array([x], pa.binary()), pa.array([n_words]), 1)[0]
    return Weights(one, d2, d3)


def _by_shard(rows: DataFrame, fn) -> DataFrame:
    return rows.groupBy("shard", "kind").applyInArrow(fn, _ROW)


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three bit numbers of each key; bits: below 2^32."""
    h = keys.astype(np.uint64)
    for multiplier in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        x = (h ^ (h >> np.uint64(31))) * np.uint64(multiplier)
        yield (((x ^ (x >> np.uint64(29))) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def gram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each gram: a triple's is that of the pair that starts it."""
    return shard_of(np.where(keys < 0, ~keys, keys >> _BITS), shards)


def bloom(grams: DataFrame, n: int, shards: int = 1, keys=lambda rows: np.asarray(rows["g"])) -> np.ndarray:
    """A filter of n grams as 64-bit words, a row for each shard: its task
    sends that row alone, so the driver gets the filter once. grams: with
    several shards, rows of column ``shard`` of which ``keys`` makes the grams."""
    size = max(1, min(MOST_BITS, BITS_A_GRAM * n) // (64 * shards))

    def run(rows: pa.Table) -> pa.Table:
        own = np.zeros(8 * size, np.uint8)
        for at in _places(keys(rows), 64 * size):
            np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return pa.table([rows["shard"].slice(0, 1).cast(pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["shard", "f"])

    out = np.zeros((shards, size), np.int64)
    rows = grams if shards > 1 else grams.withColumn("shard", F.lit(0))
    got = rows.groupBy("shard").applyInArrow(run, "shard int, f binary").toArrow()
    for shard, f in zip(got["shard"].to_pylist(), got["f"], strict=True):
        out[shard] = np.frombuffer(f.as_buffer(), np.int64)
    return out


def may_have(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    shard = gram_shard(keys, len(filter_)) if len(filter_) > 1 else 0
    out = np.ones(len(keys), bool)
    for at in _places(keys, 64 * filter_.shape[1]):
        out &= (filter_[shard, at >> 6] >> (at & 63)) & 1 == 1
    return out


class Head:
    """What every task has of the model: the words' numbers, log10 p and h by
    number, the most frequent grams (in order) with their corrections, and the
    filter of the others. It travels packed."""

    def __init__(self, words_: Words, model: Weights, grams: np.ndarray, weights: np.ndarray, others: np.ndarray):
        self.words, self.model, self.p, self.h, self.grams, self.weights, self.others = words_, model, model.p, model.h, grams, weights, others

    def __reduce__(self):
        return _head, (self.words, self.model, pack(np.diff(self.grams, prepend=0)), self.weights, self.others)

    @property
    def ids(self) -> dict[bytes, int]:
        return self.words.ids

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The corrections of the keys (0 where the head has none), where it
        has one, and where the shards may."""
        out, found, maybe = np.zeros(len(keys)), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
            found = self.grams[at] == keys
            out[found] = self.weights[at[found]]
        rest = np.flatnonzero(~found)
        maybe[rest] = may_have(self.others, keys[rest])
        return out, found, maybe

    def losses(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability by what is here and the tokens of each text; and
        what the shards may add: text number, gram, times, in order of texts.
        A gram is a triple, below zero (~) if its first pair is asked for too,
        or a pair with START after it."""
        total, tokens, left = np.zeros(len(texts)), np.zeros(len(texts), np.int64), []
        parts: list[tuple[int, np.ndarray]] = []
        size = 0

        def work() -> None:
            x = np.concatenate([p for _, p in parts])
            doc = np.repeat(np.array([i for i, _ in parts]), [len(p) for _, p in parts])
            own = x != START  # a text ends before the next one's START
            to = np.flatnonzero(own)
            np.add.at(total, doc[to], self.p[x[to]] + self.h[x[to - 1]])
            at = np.flatnonzero(doc[1:] == doc[:-1])  # where a pair starts
            pair = pairs_of(x)[at]
            weights, found, maybe = self.look(pair)
            np.add.at(total, doc[at], weights)
            known = np.zeros(len(x), bool)
            known[at] = found | maybe
            at3 = np.flatnonzero(known[:-2] & known[1:-1])  # a triple that is there has both its pairs there
            triple = triples_of(x)[at3]
            weights, _, maybe3 = self.look(triple)
            np.add.at(total, doc[at3], weights)
            asks = np.zeros(len(x), bool)
            asks[at[maybe]] = True
            both, asks[at3[maybe3]] = asks[at3[maybe3]], False
            alone, sent = np.flatnonzero(asks), triple[maybe3]
            left.append((np.concatenate([doc[alone], doc[at3[maybe3]]]), np.concatenate([(x[alone] << 2 * _BITS) | (x[alone + 1] << _BITS) | START, np.where(both, ~sent, sent)])))

        for i, t in enumerate(texts):
            ws = words(t)
            tokens[i] = len(ws) + 1
            x = encode(self.ids, ws)
            if size + len(x) > CHUNK and parts:
                work()
                parts, size = [], 0
            parts.append((i, x))
            size += len(x)
        if parts:
            work()
        empty = np.empty(0, np.int64)
        doc, gram = (np.concatenate([y[k] for y in left]) if left else empty for k in (0, 1))
        order = np.lexsort((gram, doc))
        doc, gram = doc[order], gram[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]))[: len(doc)])
        return total, tokens, doc[first], gram[first], np.diff(np.append(first, len(doc)))


def _head(words_: Words, model: Weights, grams: bytes, weights: np.ndarray, others: np.ndarray) -> Head:
    keys = np.cumsum(unpack(pa.array([grams], pa.binary()), pa.array([len(weights)]), 1)[0])
    head = Head(words_, model, keys, weights, others)
    head.model = None  # tasks need its p and h alone
    return head


class Model(NamedTuple):
    head: Broadcast  # of Head
    others: DataFrame  # packed counts by shard
    weights: Broadcast  # of Weights, for those that don't need the words
    shards: int


def train(texts: DataFrame) -> Model:
    """texts: text (binary) of those that train. Words are counted first; then
    the tasks, given the words' numbers, count packed triples."""
    spark = texts.sparkSession
    context = spark.sparkContext

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter(w for t in b.column(0).to_pylist() for w in words(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    vocabulary = texts.mapInArrow(count_words, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(VOCABULARY - FIRST).toArrow()
    named = Words(vocabulary["w"])
    n_words, shards = FIRST + named.n, LEAST_SHARDS + int(pa.compute.sum(vocabulary["n"]).as_py() or 0) // SHARD_WORDS
    del vocabulary
    shared = context.broadcast(named)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> list[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            return _rows(_dealt(shard_of(key & ((1 << 2 * _BITS) - 1), shards), TRIPLES, key, n)).to_batches()

        keys, size = [], 0
        for t in (t for b in batches for t in b.column(0).to_pylist()):
            keys.append(triples_of(encode(shared.value.ids, words(t))))
            size += len(keys[-1])
            if size > GATHERED * CHUNK:
                yield from counted()
                keys, size = [], 0
        if keys:
            yield from counted()

    counts = stash(_by_shard(texts.mapInArrow(count_triples, _ROW), lambda rows: merged(rows, shards, n_words)), "counts")
    shared.destroy()
    free_shuffles(spark)
    sums = _by_shard(counts.where(F.col("kind").isin(WORDS, TOTALS)), _added).toArrow()
    one = np.zeros((5, -(-n_words // _BLOCK) * _BLOCK), np.int64)
    totals = np.zeros((3, _STEPS), np.int64)
    for i, row in enumerate(sums.select(["shard", "kind"]).to_pylist()):
        columns = 5 if row["kind"] == WORDS else 3
        got = np.stack(unpack(sums["blob"].slice(i, 1), sums["size"].slice(i, 1), columns))
        if row["kind"] == WORDS:
            one[:, row["shard"] * _BLOCK :][:, :_BLOCK] = got
        else:
            totals = got
    d3, d2 = (np.array(discounts(dict(enumerate(t[:6].tolist())))) for t in totals[:2])
    made = Weights(one[:, :n_words], d2, d3)
    weights = context.broadcast(made)
    del one, sums

    table = stash(counts.where(F.col("kind").isin(TRIPLES, PAIRS)), "grams", "shard", shards)
    free_shuffles(spark)
    room, least = HEAD_GRAMS, 1 << 20
    for step in range(_STEPS - 1, -1, -1):
        room -= int(totals[2, step])
        if room < 0:
            break
        least = step
    rest = int(totals[2, : min(least, _STEPS)].sum())

    def often(rows: pa.Table) -> pa.Table:
        k, w, n, pairs, v, times = weights.value.of(rows)
        at, at2 = step_of(n) >= least, step_of(times) >= least
        return pa.table([pa.array(np.concatenate([k[at], ~pairs[at2]])), pa.array(np.concatenate([w[at], v[at2]]))], names=["g", "w"])

    def seldom(rows: pa.Table) -> np.ndarray:
        k, n, *_, pairs, _, _, times = counts_of(rows)
        return np.concatenate([k[step_of(n) < least], ~pairs[step_of(times) < least]])

    got = table.groupBy("shard").applyInArrow(often, "g bigint, w double").toArrow()
    g, w = np.asarray(got["g"]).astype(np.int64), np.asarray(got["w"]).astype(np.float64)
    order = np.argsort(g)
    g, w = g[order], w[order]
    del got, order
    free_shuffles(spark)
    others = bloom(table, rest, shards, seldom) if rest else np.zeros((shards, 1), np.int64)
    head = Head(named, made, g, w, others)
    free_shuffles(spark)
    return Model(context.broadcast(head), table if rest else table.limit(0), weights, shards)


def losses(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns but text (binary), with total (-log10 probability) and
    n_tokens (words and the end).

    A task's texts are dealt into blocks by how many grams they ask for. A
    block's grams go to their shards in packed rows, its texts' own rows beside
    them to a shard below zero; the answers of a shard to a block come back as
    one packed row, and the block adds them to its texts."""
    at, head, weights, shards = docs.columns.index("text"), model.head, model.weights, model.shards
    names = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in names)
    own_type = f"own struct<{kinds}, `{(tokens_name := fresh('n_tokens', docs))}`: bigint>"
    columns = ["shard", "block", "row", "value", "own", "size", "blob"]
    row_type = f"shard int, block bigint, row bigint, value double, {own_type}, size int, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        block, row, asked, size = task << 32, 0, [], 0
        own_arrow = None

        def sent() -> pa.RecordBatch:
            rows, gram, times = (np.concatenate(x) for x in zip(*asked, strict=True))
            asked.clear()
            key = np.where(gram < 0, ~gram, gram)
            shard = shard_of(key >> _BITS, shards)
            order = np.argsort(shard, kind="stable")
            out = []
            for i in np.split(order, _runs(shard[order])[1:]):
                a, b, c = key[i] >> 2 * _BITS, (key[i] >> _BITS) & _LOW, key[i] & _LOW
                out.append((int(shard[i[0]]), len(i), pack(np.diff(rows[i], prepend=0), a, b, c, gram[i] < 0, times[i])))
            n = len(out)
            shard, size, blob = zip(*out, strict=True)
            packed = [pa.array(shard, pa.int32()), pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, own_arrow), pa.array(size, pa.int32()), pa.array(blob, pa.binary())]
            return pa.RecordBatch.from_arrays(packed, names=columns)

        for b in batches:
            total, tokens, doc, gram, times = head.value.losses(b.column(at).to_pylist())
            n = b.num_rows
            own = pa.StructArray.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(tokens)], names=[*names, tokens_name])
            own_arrow = own.type
            kept = [pa.array(np.full(n, -1 - task), pa.int32()), pa.array(np.full(n, block)), pa.array(np.arange(row, row + n)), pa.array(total), own, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(kept, names=columns)
            if len(gram):
                asked.append((doc + row, gram, times))
                size += len(gram)
            row += n
            if size > GATHERED * CHUNK:
                yield sent()
                block, row, size = block + 1, 0, 0
        if asked:
            yield sent()

    def answer(asks: pa.Table, counts: pa.Table) -> pa.Table:
        asks, own = asks.filter(pa.compute.is_valid(asks["blob"])), asks.filter(pa.compute.is_null(asks["blob"]))
        if not len(asks) or not len(counts):
            return own
        triples, w, _, pairs, v, _ = weights.value.of(counts)
        out = []
        for at in range(len(asks)):  # a row's grams are in order of texts
            blob = asks.slice(at, 1)
            steps, a, b, c, both, times = unpack(blob["blob"], blob["size"], 6)
            rows, value = np.cumsum(steps), np.zeros(len(steps))
            for keys, of, x, here in ((triples, (a << 2 * _BITS) | (b << _BITS) | c, w, c != START), (pairs, (a << _BITS) | b, v, (both != 0) | (c == START))):
                if len(keys):
                    i = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
                    value += np.where(here & (keys[i] == of), x[i] * times, 0.0)
            first = _runs(rows)
            out.append((len(first), pack(np.diff(rows[first], prepend=0), np.add.reduceat(value, first).view(np.int64))))
        size, blob = zip(*out, strict=True)
        packed = [*(asks[c] for c in columns[:5]), pa.array(size, pa.int32()), pa.array(blob, pa.binary())]
        return pa.concat_tables([own, pa.table(packed, schema=own.schema)])

    def added(rows: pa.Table) -> pa.Table:
        own, answers = rows.filter(pa.compute.is_null(rows["blob"])), rows.filter(pa.compute.is_valid(rows["blob"])).sort_by("shard")
        at, total = np.asarray(own["row"]), np.array(own["value"])
        sums = np.zeros(len(at))
        for i in range(len(answers)):  # in order of shards, so that equal texts have equal sums
            blob = answers.slice(i, 1)
            steps, value = unpack(blob["blob"], blob["size"], 2)
            sums[np.cumsum(steps)] += value.view(np.float64)
        return pa.table([own["own"], pa.array(-(total + sums[at]))], names=["own", "total"])

    asked = docs.mapInArrow(run, row_type)
    got = asked.groupBy("shard").cogroup(model.others.groupBy("shard")).applyInArrow(answer, row_type)
    got = got.groupBy("block").applyInArrow(added, f"{own_type}, total double")
    return got.select(*(F.col("own").getField(c).alias(c) for c in names), "total", F.col("own").getField(tokens_name).alias("n_tokens"))


def quantiles(values: DataFrame, at: list[float], least: int) -> dict[str | None, list[float]]:
    """Exact quantiles of x by lang, for languages of ``least`` rows and more,
    and of all rows under None; as ``np.quantile`` gives them. Ranks are found
    in counts of steps of 0.001; then the values of those steps are fetched."""
    step = F.floor(F.col("x") * 1000)
    counts = values.groupBy("lang", step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    steps: dict[str | None, Counter[int]] = {None: Counter()}
    for r in counts:
        steps[None][r["b"]] += r["n"]
        if r["lang"] is not None:
            steps.setdefault(r["lang"], Counter())[r["b"]] += r["n"]
    steps = {g: c for g, c in steps.items() if c.total() >= (least if g is not None else 1)}
    places, wanted = {}, set()
    for g, c in steps.items():
        b = np.array(sorted(c), np.int64)
        ends = np.cumsum([c[x] for x in b.tolist()])
        for q in at:
            rank = (int(ends[-1]) - 1) * q
            for k in {int(rank), min(int(rank) + 1, int(ends[-1]) - 1)}:
                i = int(np.searchsorted(ends, k, "right"))
                places[g, k] = int(b[i]), k - int(ends[i - 1] if i else 0)
                wanted.add((g, int(b[i])))
    inside: dict[tuple[str | None, int], Counter[float]] = {w: Counter() for w in wanted}
    if wanted:
        key = F.concat("lang", F.lit("\0"), step.cast("string"))
        here = step.isin([b for g, b in wanted if g is None]) | key.isin([f"{g}\0{b}" for g, b in wanted if g is not None])
        for r in values.where(here).groupBy("lang", "x", step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            for g in {r["lang"], None}:
                if (g, r["b"]) in inside:
                    inside[g, r["b"]][r["x"]] += r["n"]

    def value(g: str | None, k: int) -> float:
        b, k = places[g, k]
        x = sorted(inside[g, b])
        return x[int(np.searchsorted(np.cumsum([inside[g, b][v] for v in x]), k, "right"))]

    out: dict[str | None, list[float]] = {}
    for g, c in steps.items():
        out[g] = []
        for q in at:
            rank = (c.total() - 1) * q
            low, high = value(g, int(rank)), value(g, min(int(rank) + 1, c.total() - 1))
            out[g].append(low + (high - low) * (rank - int(rank)))
    return out


def trusted_sample(base: DataFrame, good: DataFrame, trusted_rows: int | None = None) -> tuple[DataFrame, Column]:
    """(texts that train, which rows of ``base`` would train if trusted): two
    thirds of all trusted rows, or of about ``trusted_rows`` of them."""
    trains = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0
    if trusted_rows is not None:
        trusted = stash(base.select("doc_id", "lang").join(good, "doc_id", "left_semi"), "trusted")
        share = min(1.0, trusted_rows / max(1, trusted.count()))
        sizes = {r["lang"]: r["count"] for r in trusted.where("lang is not null").groupBy("lang").count().collect()}
        trains &= unit_of(F.col("doc_id")) < by_value({g: max(share, LANGUAGE_ROWS / n) for g, n in sizes.items()}, F.col("lang"), share)
    texts = rows_of(base.where(trains), good, "doc_id")
    texts = stash(one_text(texts, "doc_id", "lang").select("text"), "sample")
    free_shuffles(base.sparkSession)
    return texts, trains


def judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, trusted_rows: int | None) -> DataFrame:
    """doc_id, key (hash of the text), lang, total, n_tokens, limit, kept."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    good = labels.where("quality = 1").select("doc_id").distinct()
    with passing_tables(docs.sparkSession):  # the counts go once the losses are written
        with passing_tables(docs.sparkSession):  # and the texts once they are counted
            texts, trains = trusted_sample(base.select("doc_id", "text", "lang"), good, trusted_rows)
            model = train(texts)
        lost = stash(losses(base, model), "losses")
    free_shuffles(docs.sparkSession)
    unseen = stash(lost.where(~trains).join(good, "doc_id", "left_semi").select("lang", (F.col("total") / F.col("n_tokens")).alias("x")), "unseen")
    limits = quantiles(unseen, [0.5, QUANTILE], LEAST_TEXTS)
    mid, high = limits.pop(None, (0.0, float("inf")))
    middle = by_value({g: q[0] for g, q in limits.items()}, F.col("lang"), mid)
    limit = by_value({g: q[1] + SLACK * (q[1] - q[0]) for g, q in limits.items()}, F.col("lang"), high + SLACK * (high - mid))
    return lost.withColumn("limit", limit).withColumn("kept", (F.col("total") + PRIOR * middle) / (F.col("n_tokens") + PRIOR) <= F.col("limit"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trusted_rows: int | None = None) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold, kept per row.

    labels: doc_id and quality (1: trusted). The perplexity compared is pulled
    toward the language's median by ``PRIOR`` tokens; one at the limit is kept.
    Null and empty texts are the end alone; very long ones are read whole.
    Malformed UTF-8 is bytes of words. Languages of few trusted texts, and null
    ones, have the threshold of all together; without trusted texts everything
    is kept. An id trains with one text a language. Repeated rows are each
    judged, alike; an empty table gives an empty result. Other columns aren't
    looked at.
    """
    power = lambda c: F.pow(F.lit(10.0), F.least(F.lit(300.0), c))
    j = judged(docs, labels, id_col, text_col, lang_col, trusted_rows)
    return j.select("doc_id", "lang", "n_tokens", power(F.col("total") / F.col("n_tokens")).alias("perplexity"), power(F.col("limit")).alias("threshold"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trusted_rows: int | None = None) -> DataFrame:
    """The rows that are kept, with all their columns; see ``quality``. Rows of
    one id with different texts or languages are judged apart; null ids and
    texts are rows like others; an empty table stays empty."""
    bad = judged(docs, labels, id_col, text_col, lang_col, trusted_rows).where("not kept")
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("lang").alias("_lang")).distinct()
    here = docs[id_col].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text_col]) == bad["_key"]) & docs[lang_col].cast("string").eqNullSafe(bad["_lang"])
    return docs.join(bad, here, "left_anti")
