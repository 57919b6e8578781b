"""Counterfactual-regularised toxicity classifier.

Features are a text's hashed words and word beginnings, present or not. From a
bounded sample of labelled texts, the features significantly tied to toxic
texts are chosen by counts made where the texts are; a logistic model over them
is trained by gradient descent. For every labelled sentence with an identity
term, copies with the term swapped for each other term of its kind enter the
loss: the squared change of the logit is penalised, so a neutral mention of a
group does not move the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import keep_rows, one_text, prepare, sample_ids, split_of, stash

#: Expected labelled rows of each class (the bound of what the model is fitted
#: on), features of the model, hash space.
SAMPLE_ROWS, FEATURES, SPACE = 5000, 4096, 1 << 24
THRESHOLD, PENALTY, STEPS, DECAY = 0.7, 1.0, 1500, 1e-3
#: Words whose score a worker remembers.
REMEMBER = 300_000
#: Groups of identity terms that may stand for one another.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jew", "hindu", "buddhist", "atheist"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("gays", "lesbians", "bisexuals"),
    ("black", "white", "asian", "latino", "indigenous"), ("blacks", "whites", "asians", "latinos"),
    ("african", "american", "arab", "chinese", "european", "indian", "mexican"), ("africans", "americans", "arabs", "europeans", "indians", "mexicans"),
    ("immigrants", "refugees", "natives", "foreigners"), ("immigrant", "refugee", "native", "foreigner"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("muslim", "christ", "jude"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("musulman", "chrétien", "juif"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("musulmán", "cristiano", "judío"),
)
_SWAPS = {w.encode(): tuple(sorted({x.encode() for group in IDENTITY if w in group for x in group if x != w})) for w in {w for group in IDENTITY for w in group}}
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_SENTENCE = re.compile(rb"[.!?\n]+")


def words(raw: bytes | None) -> set[bytes]:
    """Different words of a whole text, A-Z lower-cased."""
    return set(_WORD.findall(raw.lower())) if raw else set()


def features(word: bytes) -> tuple[int, ...]:
    """Hashes of the word and its first 4, 5 and 6 characters."""
    out = [crc32(b"=" + word) % SPACE]
    if len(word) > 4:
        w = word.decode("utf-8", "ignore")
        out += [crc32(b"^" + w[:n].encode()) % SPACE for n in (4, 5, 6) if len(w) > n]
    return tuple(out)


def swaps(raw: bytes | None) -> list[tuple[frozenset[int], frozenset[int]]]:
    """For each sentence with an identity term and each other term of its kind:
    the features that the swap takes from the sentence, and those it adds."""
    out = []
    for sentence in _SENTENCE.split(raw or b""):
        ws = words(sentence)
        for w in ws & _SWAPS.keys():
            own, rest = set(features(w)), {f for x in ws if x != w for f in features(x)}
            out += [(frozenset(own - rest - set(new)), frozenset(set(new) - rest - own)) for new in map(features, _SWAPS[w])]
    return out


def text_features(ws: set[bytes]) -> np.ndarray:
    return np.unique(np.array([f for w in ws for f in features(w)], np.int32)) if ws else np.empty(0, np.int32)


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.weights = dict(zip(keys.tolist(), weights.tolist(), strict=True))
        self.bias = bias
        self.known: dict[bytes, tuple[int, ...]] = {}

    def score(self, raw: bytes | None) -> float:
        """Probability of the toxic label; each present feature counts once."""
        known, hit = self.known, set()
        if len(known) > REMEMBER:
            known.clear()
        for w in words(raw):
            f = known.get(w)
            if f is None:
                f = tuple(x for x in features(w) if x in self.weights)
                if len(w) <= 48:
                    known[w] = f
            if f:
                hit.update(f)
        z = self.bias + sum(self.weights[x] for x in sorted(hit))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def fit(rows: list[tuple[int, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray, int]], keys: np.ndarray) -> Model:
    """rows: label and places among keys. pairs: places that only a sentence
    and only its swapped copy has, and how many sentences. Accelerated projected gradient descent; no weight is
    below zero: what is chosen marks toxic texts, and a long clean text has
    more of everything."""
    n, m = len(rows), len(keys)
    weights, bias = np.zeros(m), 0.0
    if n and m:
        y = np.array([r[0] for r in rows], np.float64)
        size = np.array([len(r[1]) for r in rows])
        row = np.repeat(np.arange(n), size)
        col = np.concatenate([r[1] for r in rows]).astype(np.int64)
        share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
        each = 2 * PENALTY / max(1, sum(k for _, _, k in pairs))
        sharpness = 0.25 * float(share @ (size + 1)) + DECAY / n + each * sum(k * (len(a) + len(b)) for a, b, k in pairs)
        at, at_bias, t = weights, bias, 1.0
        for _ in range(STEPS):
            z = at_bias + np.bincount(row, weights=at[col], minlength=n)
            g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            grad = np.bincount(col, weights=g[row], minlength=m) + DECAY * at / n
            for a, b, k in pairs:
                d = each * k * (at[a].sum() - at[b].sum())
                grad[a] += d
                grad[b] -= d
            new, new_bias = np.maximum(0.0, at - grad / sharpness), at_bias - g.sum() / sharpness
            t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            at, at_bias = new + (before - 1) / t * (new - weights), new_bias + (before - 1) / t * (new_bias - bias)
            weights, bias = new, new_bias
    return Model(keys, weights, bias if n else -2.0)


def choose(counts: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """Features (k; a and b: toxic and clean texts that have it) tied to toxic
    texts: the ``FEATURES`` of the greatest log-likelihood ratio, among those
    at least ten times as frequent there."""
    if not toxic or not clean:
        return np.empty(0, np.int64)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda n, size: F.when(n > 0, n * F.log(n * (toxic + clean) / (size * (a + b)))).otherwise(0.0)
    tied = (a >= 3) & ((a + 0.1) / (toxic + 0.2) >= 10 * (b + 0.1) / (clean + 0.2))
    ranked = counts.where(tied).select("k", F.round(2 * (part(a, toxic) + part(b, clean)), 6).alias("g")).where("g > 15")
    return np.sort(np.array([r["k"] for r in ranked.orderBy(F.desc("g"), "k").limit(FEATURES).collect()], np.int64))


def train(rows: DataFrame) -> Model:
    """rows: doc_id, text (binary), toxic, of the learning folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, feats, swapped = b.column(1).to_pylist(), [], []
            for t in b.column(0).to_pylist():
                feats.append(text_features(words(t)))
                swapped.append([{"a": sorted(x), "b": sorted(y)} for x, y in swaps(t)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array(feats, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))],
                names=["toxic", "f", "swaps"],
            )

    sample = stash(rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, f array<int>, swaps array<struct<a:array<int>,b:array<int>>>"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    by = sample.select("toxic", F.explode("f").alias("k")).groupBy("k").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    keys = choose(by, sizes.get(1, 0), sizes.get(0, 0))
    keys = np.unique(np.concatenate([keys, np.array([f for w in _SWAPS for f in features(w)], np.int64)]))
    place = {int(k): i for i, k in enumerate(keys)}
    chosen = F.array(*[F.lit(int(k)) for k in keys])
    got = sample.select("toxic", F.array_sort(F.array_intersect("f", chosen)).alias("f")).toArrow().to_pylist()
    got.sort(key=lambda r: (r["toxic"], r["f"]))
    put = lambda fs: np.array(sorted(place[f] for f in fs), np.int64)
    pairs = sample.select(F.inline("swaps")).groupBy("a", "b").count().collect()  # at most as many as different swaps of the terms
    swapped = [(put(r["a"]), put(r["b"]), r["count"]) for r in sorted(pairs)]
    return fit([(r["toxic"], np.array([place[f] for f in r["f"]], np.int64)) for r in got], swapped, keys)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample of the labels outside the held-out fold."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    told = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").distinct().where(split_of(F.col("doc_id"), modulus) != held)
    told = sample_ids(told, "doc_id", "toxic", sample_rows)
    return train(one_text(base.join(F.broadcast(told), "doc_id"), "doc_id", "toxic").select("text", "toxic"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held: int = 1, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted per row; labels: doc_id, toxic.

    Null and empty texts have no features and the score of the bias. Very long
    texts are scored whole. A score at the threshold is predicted 1. Without
    labels of both kinds nothing is chosen and the score stays low. Labels of
    null are left out; an id teaches with one text a label. Repeated rows are
    each scored, alike; null ids are in fold 0. Malformed UTF-8 makes no
    letter. An empty table gives an empty result. Other columns aren't looked
    at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col, text_col, modulus, held, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([shared.value.score(t) for t in b.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col(id_col).alias("doc_id"), (split_of(F.col(id_col), modulus) == held).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return base.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows predicted 0, with all their columns; see ``toxicity``. Null,
    empty and repeated rows go through like others, with their own verdict; an
    empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col, text_col, sample_rows=sample_rows))
    return keep_rows(docs, lambda texts: [shared.value.score(t) < threshold for t in texts], text_col)
