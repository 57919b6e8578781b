"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed byte 1- to 4-grams, below a
linear softmax; both are trained by stochastic gradient descent in numpy on a
bounded sample of labelled texts. A temperature is fitted on a part of the
sample left out, and with it the least probability at which predictions count
as accepted. For predictions the embeddings and the linear layer collapse into
one table of bucket scores (where there are at most ``WIDTH`` languages; beyond,
the layers stay apart), so every text is read whole at array speed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import decoded, one_text, prepare, sample_ids, split_of

BUCKETS, WIDTH, ORDERS = 1 << 16, 16, (1, 2, 3, 4)
#: Labelled texts that the model is fitted on, over all languages, in
#: expectation, and of each language at least. Every language is learnt.
SAMPLE_ROWS, LANGUAGE_ROWS = 2400, 8
EPOCHS, RATE, ACCEPT = 6, 0.5, 0.99
UNKNOWN = "und"
#: Bytes worked on at once.
CHUNK = 2_000_000


def buckets_of(a: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """For each order, the bucket of the gram that starts at each byte."""
    h = np.zeros(len(a), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(a) - n + 1] ^ a[n - 1 :]) * np.uint32(0x01000193) + np.uint32(n)
        if n in ORDERS:
            yield ((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1)).astype(np.int64)


def _clean(raw: bytes) -> np.ndarray:
    """Lower-cased bytes between spaces; other ASCII than letters is space."""
    return np.frombuffer(raw.lower().translate(_TABLE), np.uint8).astype(np.uint32)


_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def text_buckets(raw: bytes) -> Iterator[np.ndarray]:
    """The buckets of all grams of a text, some at a time. A piece of a long
    text gives the grams that start in it; they may end in the next."""
    for at in range(0, len(raw), CHUNK):
        for k in buckets_of(_clean(raw[at : at + CHUNK + max(ORDERS) - 1])):
            yield k[:CHUNK]


def text_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and their shares."""
    counts = np.zeros(BUCKETS, np.int64)
    for k in text_buckets(raw):
        counts += np.bincount(k, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(1, counts.sum())).astype(np.float32)


class Model:
    """languages, embeddings, linear layer, bias, temperature and least."""

    def __init__(self, languages: list[str], embed: np.ndarray, linear: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.0):
        self.languages, self.bias, self.temperature, self.least = languages, bias, temperature, least
        one = len(languages) <= WIDTH
        self.table, self.linear = (np.ascontiguousarray(embed @ linear), None) if one else (embed, linear)

    def top(self, mean: np.ndarray) -> np.ndarray:
        """Logits of the mean of table rows."""
        return (mean if self.linear is None else mean @ self.linear) + self.bias

    def logits(self, raw: bytes) -> np.ndarray:
        total, n = np.zeros(self.table.shape[1]), 0
        for k in text_buckets(raw):
            total += self.table[k].sum(axis=0)
            n += len(k)
        return self.top(total / max(1, n))

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> Model | None:
    """rows: buckets, shares, language. A fifth calibrates."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 20 * len(languages) else order[:0]
    train = order[len(held) :]
    number = {g: i for i, g in enumerate(languages)}
    label = np.array([number[r[2]] for r in rows])
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    linear, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weight = len(train) / np.maximum(1, np.bincount(label[train], minlength=len(languages))) / len(languages)
    for epoch in range(EPOCHS):
        for i in rng.permutation(train):
            at, share, _ = rows[i]
            hidden = share @ embed[at]
            z = hidden @ linear + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            p *= RATE * (1 - epoch / EPOCHS) * min(4.0, weight[label[i]])
            back = linear @ p
            linear -= np.outer(hidden, p)
            bias -= 0.1 * p
            embed[at] -= np.outer(share * min(64.0, 1 / max(1e-6, float((share * share).sum()))), back)
    model = Model(languages, embed, linear, bias)
    if len(held):
        z = np.stack([model.top(rows[i][1] @ model.table[rows[i][0]]) for i in held])
        y, best = label[held], np.inf
        for t in np.geomspace(0.05, 20, 60):
            model.temperature, before = t, model.temperature
            loss = -np.log(np.maximum(model.probabilities(z)[np.arange(len(y)), y], 1e-12)).mean()
            if loss < best:
                best = loss
            else:
                model.temperature = before
        p = model.probabilities(z)
        right, sure = p.argmax(axis=1) == y, p.max(axis=1)
        for t in np.unique(np.concatenate([[0.0], sure])):
            if right[sure >= t].mean() >= ACCEPT:
                model.least = float(t)
                break
    return model


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """rows: doc_id, text (binary), lang. The features of the sampled texts are
    made where the texts are; they alone reach the driver."""
    labelled = rows.where("lang is not null and text is not null")
    n = labelled.select("lang").distinct().count()
    sample = one_text(sample_ids(labelled, "doc_id", "lang", max(LANGUAGE_ROWS, sample_rows // max(1, n))), "doc_id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary()), b.column(1)], names=["k", "s", "lang"])

    got = sample.select("text", "lang").mapInArrow(run, "k binary, s binary, lang string").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["k"], r["s"]))
    return fit([(np.frombuffer(r["k"], np.int32), np.frombuffer(r["s"], np.float32), r["lang"]) for r in got])


def has_letter(raw: bytes | None) -> bool:
    return bool(raw) and any(c.isalpha() for c in decoded(raw))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected per row.

    ``und`` with score 0 for null texts and those without a letter, and for
    all if no row teaches a language. ``rejected`` marks predictions below the
    calibrated least probability; the prediction itself stays. Very long texts
    are read whole, in pieces. Languages that tie go by name. Malformed UTF-8
    is no letter. Null ids count as fold 0. Repeated rows are each predicted,
    alike; an id teaches with one text a language. An empty table gives an
    empty result. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), (split_of(F.col(id_col), modulus) == held).alias("held_out"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(base.where("not held_out").select("doc_id", "text", "lang"), sample_rows)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores, out = [], [], []
            for t in b.column(2).to_pylist():
                if m is None or not has_letter(t):
                    names.append(UNKNOWN), scores.append(0.0), out.append(True)
                    continue
                p = m.probabilities(m.logits(t))
                i = int(p.argmax())
                names.append(m.languages[i]), scores.append(float(p[i])), out.append(bool(p[i] < m.least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return base.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
