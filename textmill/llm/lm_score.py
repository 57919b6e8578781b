"""Language-model scores: a context tree over binary-decomposed bytes, and an
add-one unigram model of words beside it.

One pass counts, per task, the words and the byte (D+1)-grams of all training
texts; both are summed by one shuffle. The byte grams give the counts of every
context of 0 to D bytes. In each context, a byte is eight binary decisions at
the nodes of its prefix; a node's Krichevsky-Trofimov block probability and
those of its longer contexts are mixed half and half (context-tree weighting),
and the weights that the training data leave give the coding distribution.
No context is dropped: the tree is sharded by the last ``SHARD`` bytes of the
contexts, so that a task holds whole subtrees. A first pass sums what the
shards' roots give to the nodes above them, whose number the alphabet bounds;
a second one, given those, writes the log-probability of each different gram.

Frequent words and grams (at most ``HEAD_WORDS`` and ``HEAD_GRAMS``) are looked
up in broadcast maps; all others are joined with their table by a shuffle of
distinct (row, word) and (row, gram).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import prepare, split_of, stash

DEPTH = 5
HEAD_WORDS, HEAD_GRAMS = 200_000, 2_000_000
#: Last context bytes that a shard's contexts share, and grams of whole shards
#: worked on at once.
SHARD, PIECE = 3, 100_000
#: Steps to a unit in sums of logarithms, which are exact in any order.
_UNIT = float(1 << 24)
#: Stands for the end token; no word holds a space.
END = b" "
#: Bytes of text worked on at once, and words or grams held in a task.
CHUNK, HELD = 4_000_000, 400_000


def byte_grams(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, text numbers) in chunks. A gram's low byte is the symbol, the
    next its last context byte. Contexts start as zeros; a zero ends a text."""
    parts, size = [], 0

    def made(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        pad = b"\0" * depth
        a = np.frombuffer(b"".join(pad + p for _, p in parts), np.uint8)
        n = np.array([depth + len(p) for _, p in parts])
        k = a.astype(np.int64)
        for d in range(1, depth + 1):
            k[d:] |= a[:-d].astype(np.int64) << (8 * d)
        own = np.ones(len(a), bool)
        starts = np.cumsum(n) - n
        for d in range(depth):
            own[starts + d] = False
        return k[own], np.repeat(np.array([i for i, _ in parts]), n)[own]

    for i, t in enumerate(texts):
        t += b"\0"
        if len(t) > CHUNK:  # a very long text: pieces that repeat the context before them
            for at in range(0, len(t), CHUNK):
                piece = t[max(0, at - depth) : at + CHUNK]
                k, d = made([(i, piece)])
                skip = at - max(0, at - depth)
                yield k[skip:], d[skip:]
            continue
        if size + len(t) > CHUNK and parts:
            yield made(parts)
            parts, size = [], 0
        parts.append((i, t))
        size += len(t)
    if parts:
        yield made(parts)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, unique = pd.factorize(np.concatenate(keys))
    return unique, np.bincount(codes, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)


def corpus_counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """w, g, n: counts of words (w; END: texts) and byte grams (g; w null).

    Texts with a true second column are not counted; their grams are there
    with 0 where no other text has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(w: list, g: np.ndarray | None, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()) if g is None else pa.nulls(len(g), pa.binary()), pa.nulls(len(w), pa.int64()) if g is None else pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["w", "g", "n"])

        words: Counter[bytes] = Counter()
        keys, counts, held = [], [], 0
        for b in batches:
            texts = [(t or b"").lower() for t in b.column(0).to_pylist()]
            used = ~np.array(b.column(1).to_pylist(), bool) if b.num_columns > 1 else np.ones(len(texts), bool)
            words[END] += int(used.sum())
            for t, u in zip(texts, used.tolist(), strict=True):
                if u:
                    words.update(t.split())
            for k, doc in byte_grams(texts, depth):
                codes, unique = pd.factorize(k)
                keys.append(unique)
                counts.append(np.bincount(codes, weights=used[doc], minlength=len(unique)).astype(np.int64))
                held += len(unique)
            if held > 4 * HELD:
                k, n = _merge(keys, counts)
                keys, counts, held = [k], [n], len(k)
                if held > 2 * HELD:
                    yield rows([], k, n)
                    keys, counts, held = [], [], 0
            if len(words) > HELD:
                yield rows(list(words), None, list(words.values()))
                words.clear()
        if words:
            yield rows(list(words), None, list(words.values()))
        if keys:
            k, n = _merge(keys, counts)
            yield rows([], k, n)

    return texts.mapInArrow(run, "w binary, g bigint, n bigint").groupBy("w", "g").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0, by Stirling's series above 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    while (low := y < 8).any():
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def _block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - math.log(math.pi) - _lgamma(n0 + n1 + 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _climb(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, low: int, high: int, below: np.ndarray | None = None) -> list[tuple]:
    """Nodes with ``low`` to ``high`` context bytes, by depth: first places,
    zeros, ones, ln mixed probability, weight of stopping.

    key: sorted; the bits so far after a leading one, then ``high`` context
    bytes, the last one first. below: what lies under the deepest nodes."""
    out: list[tuple] = []
    for d in range(high, low - 1, -1):
        k = key >> (8 * (high - d))
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        z, o = np.add.reduceat(n0, starts), np.add.reduceat(n1, starts)
        mixed, own = np.where(z + o > 0, _block(z, o), 0.0), np.ones(len(starts))
        if out or below is not None:
            under = np.add.reduceat(out[0][3], np.searchsorted(out[0][0], starts)) if out else np.add.reduceat(below, starts)
            block, mixed = mixed, np.logaddexp(mixed, under) - math.log(2)
            own = np.exp(block - math.log(2) - mixed)
        out.insert(0, (starts, z, o, mixed, own))
    return out


def _descend(nodes: list[tuple], p: np.ndarray, acc: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of a one at each key by its deepest node with data (``p``
    where none has), and what is mixed so far and left for deeper nodes."""
    for starts, z, o, _, own in nodes:
        n, a, r = z + o, acc[starts], rest[starts]
        kt, width = (o + 0.5) / (n + 1), np.diff(np.append(starts, len(p)))
        p = np.where(np.repeat(n > 0, width), np.repeat(a + r * kt, width), p)
        acc, rest = np.repeat(a + r * own * kt, width), np.repeat(r * (1 - own), width)
    return p, acc, rest


def _decisions(g: np.ndarray, n: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each of the eight bits: the order of the keys, the keys in it,
    their zeros and ones, and the grams' bits."""
    context, byte = np.zeros(len(g), np.int64), g & 255
    for d in range(1, depth + 1):
        context = (context << 8) | ((g >> (8 * d)) & 255)
    for i in range(8):
        key = (((1 << i) | (byte >> (8 - i))) << (8 * depth)) | context
        order = np.argsort(key)
        bit, w = (byte[order] >> (7 - i)) & 1, n[order].astype(np.float64)
        yield order, key[order], w * (bit == 0), w * bit, bit


def _pieces(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of whole shards, from rows in order of shards."""
    keys, counts, held, most = [], [], 0, PIECE
    for b in batches:
        keys.append(np.asarray(b.column(0)))
        counts.append(np.asarray(b.column(1)))
        held += b.num_rows
        if held >= most:
            g, n = np.concatenate(keys), np.concatenate(counts)
            c = (g >> 8) & ((1 << (8 * shard)) - 1)
            cut = int(np.searchsorted(c, c[-1]))
            if cut:
                yield g[:cut], n[:cut]
            keys, counts, held = [g[cut:]], [n[cut:]], len(g) - cut
            most = max(PIECE, 2 * held)
    if held:
        yield np.concatenate(keys), np.concatenate(counts)


def gram_logs(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """g, n, p: log10 probability of each gram's symbol after its context, by
    the tree of all grams with their counts (g, n; 0: only asked for)."""
    shard = min(SHARD, depth)
    deeper = 8 * (depth - shard + 1)  # bits of context that the top doesn't have
    dealt = grams.withColumn("c", F.shiftright("g", 8).bitwiseAND(F.lit((1 << (8 * shard)) - 1))).repartition("c").sortWithinPartitions("c").select("g", "n")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n in _pieces(batches, shard):
            for _, key, n0, n1, _ in _decisions(g, n, depth):
                starts, z, o, mixed, _ = _climb(key, n0, n1, shard, depth)[0]
                k = key[starts] >> deeper
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                sums = [np.add.reduceat(x.astype(np.int64), first) for x in (z, o, np.rint(mixed * _UNIT))]
                yield pa.RecordBatch.from_arrays([pa.array(k[first]), *map(pa.array, sums)], names=["k", "z", "o", "m"])

    top = None
    if shard:
        got = dealt.mapInArrow(roots, "k bigint, z bigint, o bigint, m bigint").groupBy("k").agg(F.sum("z").alias("z"), F.sum("o").alias("o"), F.sum("m").alias("m")).toArrow()
        k, z, o, m = (np.asarray(got[x]).astype(np.int64) for x in ("k", "z", "o", "m"))
        at = np.argsort(k)
        size = len(k)
        state = np.full(size, 0.5), np.zeros(size), np.ones(size)
        if size:
            state = _descend(_climb(k[at], z[at].astype(np.float64), o[at].astype(np.float64), 0, shard - 1, m[at] / _UNIT), *state)
        top = grams.sparkSession.sparkContext.broadcast((k[at], *state))

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n in _pieces(batches, shard):
            total = np.zeros(len(g))
            for order, key, n0, n1, bit in _decisions(g, n, depth):
                if top is None:
                    state = np.full(len(g), 0.5), np.zeros(len(g)), np.ones(len(g))
                else:
                    at = np.searchsorted(top.value[0], key >> deeper)
                    state = tuple(x[at] for x in top.value[1:])
                one = _descend(_climb(key, n0, n1, shard, depth), *state)[0]
                total[order] += np.log10(np.where(bit, one, 1 - one))
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(total.astype(np.float32))], names=["g", "n", "p"])

    return dealt.mapInArrow(logs, "g bigint, n bigint, p float")


def _frequent(rows: DataFrame, n: int, steps: int) -> tuple[int, int, int]:
    """The least step of counts from which at most n rows are; rows and sum."""
    got = rows.where("n > 0").groupBy(F.floor(steps * F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()  # at most 64 * steps rows
    room, least = n, 1 << 20
    for r in sorted(got, reverse=True):
        room -= r["v"]
        if room < 0:
            break
        least = r["step"]
    return least, sum(r["v"] for r in got), sum(r["n"] for r in got)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte per row.

    Null texts score as empty ones: the end alone. Very long texts are counted
    and scored whole, in pieces. Repeated rows are counted and scored each,
    alike. Without training rows all counts are zero and each byte decision is
    even. A null id is in fold 0. Malformed UTF-8 is bytes like others. An
    empty table gives an empty result. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), (split_of(F.col(id_col), modulus) == held).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    counts = stash(corpus_counts(base.select("text", "held_out"), depth), "counts")
    words = counts.where("w is not null and n > 0").select("w", "n")
    least, types, tokens = _frequent(words, HEAD_WORDS, 8)
    often = F.floor(8 * F.log2("n")) >= least
    got = words.where(often).toArrow()
    logs = np.log10(np.asarray(got["n"]).astype(np.float64) + 1)
    head = spark.sparkContext.broadcast(dict(zip(got["w"].to_pylist(), logs.tolist(), strict=True)))
    grams = stash(gram_logs(counts.where("w is null").select("g", "n"), depth), "grams")
    least, _, _ = _frequent(grams, HEAD_GRAMS, 4)
    common = (F.col("n") > 0) & (F.floor(4 * F.log2("n")) >= least)
    got = grams.where(common).select("g", "p").toArrow()
    keys = np.asarray(got["g"]).astype(np.int64)
    at = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[at], np.asarray(got["p"]).astype(np.float32)[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, known = TaskContext.get().partitionId() << 40, head.value
        keys, logs = table.value
        for b in batches:
            texts = [(t or b"").lower() for t in b.column(2).to_pylist()]
            size, seen, total, rare = [], [], [], []
            for t in texts:
                words = t.split()
                words.append(END)
                found = [known[w] for w in words if w in known]
                size.append(len(words))
                seen.append(len(found))
                total.append(math.fsum(found))
                rare.append(list(Counter(w for w in words if w not in known).items()) if len(found) < len(words) else [])
            n = len(texts)
            score, docs, left, times = np.zeros(n), [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k, doc in byte_grams(texts, depth):
                codes, unique = pd.factorize(k)
                at, there = _find(keys, unique)
                p = np.zeros(len(unique))
                p[there] = logs[at[there]]
                score += np.bincount(doc, weights=p[codes], minlength=n)
                if not there.all():
                    miss = ~there[codes]
                    pair, m = np.unique(doc[miss] * len(unique) + codes[miss], return_counts=True)
                    docs.append(pair // len(unique))
                    left.append(unique[pair % len(unique)])
                    times.append(m)
            doc = np.concatenate(docs)  # ascending: chunks are in order of texts
            offsets = np.cumsum([0, *map(len, rare)])
            flat = pa.StructArray.from_arrays([pa.array([w for r in rare for w, _ in r], pa.binary()), pa.array([n for r in rare for _, n in r], pa.int64())], names=["w", "k"])
            others = pa.StructArray.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(times))], names=["g", "k"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.arange(row, row + n)), pa.array(size, pa.int64()), pa.array(seen, pa.int64()), pa.array(total, pa.float64()), pa.array(score), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), others)],
                names=["doc_id", "held_out", "row", "n_tokens", "seen", "total", "head_score", "n_bytes", "rare", "grams"],
            )
            row += n

    schema = f"doc_id {kind}, held_out boolean, row bigint, n_tokens bigint, seen bigint, total double, head_score double, n_bytes bigint, rare array<struct<w:binary,k:bigint>>, grams array<struct<g:bigint,k:bigint>>"
    scored = stash(base.mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.inline("rare")).join(words.where(~often), "w").groupBy("row").agg(F.sum("k").alias("rare_seen"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("rare_total"))
    others = scored.select("row", F.inline("grams")).join(grams.where(~common).select("g", "p"), "g").groupBy("row").agg(F.sum(F.col("k") * F.col("p").cast("double")).alias("tail_score"))
    zero = F.lit(0)
    score = F.col("head_score") + F.coalesce("tail_score", zero.cast("double"))
    return scored.drop("rare", "grams").join(rare, "row", "left").join(others, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("seen") + F.coalesce("rare_seen", zero)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("rare_total", zero.cast("double")) - F.col("n_tokens") * math.log10(tokens + types + 1)).alias("base_score"),
        score.alias("score"),
        (-score / math.log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
