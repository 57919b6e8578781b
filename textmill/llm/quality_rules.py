"""Quality by hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams: the raw corpus
(counted over every text) and the trusted target (two thirds of all texts
labelled as good). A text's score is the sum of its n-grams' log ratios per
n-gram; texts below a fixed threshold, taken from the scores of the third of
the trusted texts that the target hasn't seen, are not kept. Both passes keep
one bounded table of counts per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import decoded, one_text, prepare, rows_of, sample_ids, stash
from textmill.llm.perplexity import quantiles

#: Hash buckets of unigrams, and as many of bigrams.
BUCKETS = 1 << 16
#: Pseudo n-grams of ratio zero, so that very short texts aren't judged hard.
PRIOR = 20
#: The threshold: this quantile of the trusted scores, less ``SLACK`` times
#: its distance to their median.
QUANTILE, SLACK = 0.005, 0.5
_SYMBOLS = b"#*$%&|<>"


def features(raw: bytes | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of a text's lower-cased unigrams, then its bigrams."""
    words = raw.lower().split() if raw else []
    h = np.fromiter(map(crc32, words), np.int64, len(words))
    pair = (h[:-1] * 0x9E3779B1 + h[1:] * 0x85EBCA77) & 0x7FFFFFFFFFFF
    return np.concatenate([h % buckets, buckets + (pair >> 13) % buckets])


def repeat_words(split: list[list[bytes]], size: int = 5) -> np.ndarray:
    """Per text: words inside windows of ``size`` words that occur twice or
    more in it. Windows are numbered exactly, by joining numbered halves."""
    n = np.fromiter(map(len, split), np.int64, len(split))
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for words in split for w in words), np.int64, int(n.sum()))
    if len(a) < size:
        return np.zeros(len(split), np.int64)
    number = a
    for step in range(1, size):
        number = pd.factorize(number[:-1] * (len(ids) + 1) + a[step:])[0].astype(np.int64)
    doc = np.repeat(np.arange(len(split)), n)
    starts = np.flatnonzero(doc[: len(number)] == doc[size - 1 :])
    codes = pd.factorize(doc[starts] * (int(number.max()) + 1) + number[starts])[0]
    again = starts[np.bincount(codes)[codes] >= 2] if len(codes) else starts
    step = np.zeros(len(a) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + size, -1)
    return np.bincount(doc, weights=np.cumsum(step[:-1]) > 0, minlength=len(split)).astype(np.int64)


def base_counts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    split = [t.split() if t else [] for t in texts]

    def dup_lines(t: bytes | None) -> int:
        seen: set[bytes] = set()
        n = 0
        for line in t.split(b"\n") if t else ():
            if line in seen:
                n += 1
            elif line.strip():
                seen.add(line)
        return n

    of = lambda xs: np.fromiter(xs, np.int64, len(texts))
    return {
        "n_words": of(map(len, split)),
        "word_chars": of(len(decoded(b" ".join(words))) - max(0, len(words) - 1) for words in split),
        "n_symbols": of(len(t) - len(t.translate(None, _SYMBOLS)) if t else 0 for t in texts),
        "n_dup_lines": of(map(dup_lines, texts)),
        "n_repeat_words": repeat_words(split),
    }


def count_features(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each bucket over all texts (column text, binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * buckets, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount(features(t, buckets), minlength=2 * buckets) if t and len(t) > 1 << 17 else 0
                if t and len(t) <= 1 << 17:
                    np.add.at(total, features(t, buckets), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["k", "n"])

    out = np.zeros(2 * buckets, np.int64)
    got = texts.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[np.asarray(got["k"])] = np.asarray(got["n"])
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """ln of add-one target over raw probabilities; unigrams and bigrams are
    each a multinomial."""
    out = np.empty(len(raw), np.float64)
    half = len(raw) // 2
    for s in (slice(0, half), slice(half, None)):
        t, r = target[s] + 1.0, raw[s] + 1.0
        out[s] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def llr(raw: bytes | None, ratios: np.ndarray, prior: int = PRIOR) -> float:
    k = features(raw, len(ratios) // 2)
    return float(ratios[k].sum() / (len(k) + prior)) if len(k) else 0.0


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score per row; labels: doc_id and quality (1: trusted).

    Null, empty and wordless texts have no words and fail the base. Very long
    texts are judged whole. A score at the threshold is kept. Without any
    trusted text the method's verdict is to keep. Malformed UTF-8 is one
    character a fault. Repeated rows are each judged, alike; an id teaches with
    one text. An empty table gives an empty result. Columns other than the id
    and text are not looked at. target_rows: about so many trusted rows, by the
    hash of their id, in place of all.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    if target_rows is not None:
        trusted = sample_ids(trusted, "doc_id", None, target_rows)
    sample = stash(one_text(rows_of(base, trusted, "doc_id"), "doc_id"), "target")
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    raw = count_features(base.select("text"))
    ratios = log_ratios(count_features(sample.where(~unseen).select("text")), raw)
    shared = spark.sparkContext.broadcast(ratios.astype(np.float32))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([llr(t, shared.value) for t in b.column(0).to_pylist()], pa.float64())], names=["s"])

    own = stash(sample.where(unseen).select("text").mapInArrow(scores, "s double").select(F.lit(None).cast("string").alias("lang"), F.col("s").alias("x")), "unseen")
    found = quantiles(own, [QUANTILE, 0.5], 1).get(None)
    least = found[0] - SLACK * (found[1] - found[0]) if found else -float("inf")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            c = base_counts(texts)
            score = np.array([llr(t, shared.value) for t in texts], np.float64)
            failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c[n]) for n in names), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)], names=["doc_id", *names, "base_failed", "kept", "score"])

    return base.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean, score double")
