"""Model-backed steps behind small interfaces, with offline implementations.

A provider is a picklable function over a list of texts. ``apply`` runs it on
Arrow batches, with the retry schedule for transient failures inside the task
(a Spark task retry would repeat calls that have succeeded).
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from textmill.workers import reach

#: The wait before each further attempt, in seconds.
BACKOFF = (2, 5, 15, 30, 60)


class Transient(Exception):
    """A failure that a later attempt may not have."""


def with_retry(call: Callable, attempts: int = 5, backoff: tuple[float, ...] = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Retries on ``Transient``, connection and time-out errors alone."""

    def run(*args):
        for i in range(attempts):
            try:
                return call(*args)
            except (Transient, ConnectionError, TimeoutError):
                if i == attempts - 1:
                    raise
                sleep(backoff[min(i, len(backoff) - 1)])

    return run


def hash_embedder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Signed feature hashing of words, of unit length. Deterministic."""

    def embed(texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = np.zeros((len(texts), width))
        for row, t in zip(out, texts, strict=True):
            for w, n in Counter(re.findall(r"\w+", (t or "").lower())).items():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % width] += n if h >> 63 else -n
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def frequent_words(most: int = 8, shortest: int = 4) -> Callable[[list[str]], list[list[str]]]:
    """The most frequent longer words of a text, ties in alphabetical order."""

    def pick(texts: list[str]) -> list[list[str]]:
        return [[w for w, _ in sorted(Counter(w for w in re.findall(r"\w+", (t or "").lower()) if len(w) >= shortest).items(), key=lambda x: (-x[1], x[0]))[:most]] for t in texts]

    return pick


def extractive_answer(texts: list[str]) -> list[str]:
    """Stands in for a language model: the first context line of a prompt."""
    return [next((line for line in (t or "").split("\n")[2:] if line and not line.startswith("[source_file:")), "") for t in texts]


def apply(df: DataFrame, text_col: str, out_col: str, kind: str, provider: Callable[[list[str]], list], batch: int = 100) -> DataFrame:
    """Adds ``out_col``: the provider's result, called on ``batch`` texts."""
    reach(df.sparkSession)
    call = with_retry(provider)
    at = df.columns.index(text_col)
    schema = df.limit(0).selectExpr("*", f"cast(null as {kind}) as `{out_col}`").schema
    field = pa.field(out_col, _arrow(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(at).to_pylist(), []
            for i in range(0, len(texts), batch):
                out += call(texts[i : i + batch])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, field.type)], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    plain = {"string": pa.string(), "float": pa.float32(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]
