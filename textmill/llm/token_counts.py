"""Exact token length histogram with suffix sums.

Documents are encoded and counted by length in their own task; only the counts
are shuffled. Suffix sums over the histogram answer the total, the quantiles
and the truncated total for every context limit without another look at text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import prepare, stash
from textmill.llm.encoding import encoder, vocabulary

#: Lengths of one bucket of the two-level suffix sums.
BUCKET = 64


def histogram(docs: DataFrame, text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many texts have how many tokens (null: 0)."""
    prepare(docs.sparkSession)
    path = vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), Counter()
        for b in batches:
            seen.update(len(ids) // 4 for ids in enc.ids(b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n"])

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "n_tokens bigint, n bigint").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """hist is read twice. Per length L: docs_ge, tokens_ge (texts of L tokens or more), truncated
    (tokens if texts are cut at L), docs_le and its share quantile, and the
    totals. A window runs within a bucket of lengths; over the buckets' sums
    runs a second one, of one row per bucket."""
    t = hist.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = t.groupBy("bucket").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    above, every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = sums.select(
        "bucket",
        F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("above_docs"),
        F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("above_tokens"),
        F.sum("bd").over(every).alias("total_docs"),
        F.sum("bt").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = t.join(sums, "bucket").select(
        "n_tokens",
        "n_docs",
        (F.col("above_docs") + F.sum("n_docs").over(within)).alias("docs_ge"),
        (F.col("above_tokens") + F.sum("tokens").over(within)).alias("tokens_ge"),
        "total_docs",
        "total_tokens",
    )
    below = F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")
    return s.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        below.alias("docs_le"),
        (below / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def token_counts(docs: DataFrame, text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """The suffix sums of the texts' token histogram, a row per length.

    Null and empty texts have length 0; repeated rows count each; an empty
    table gives no row. Other columns are not looked at.
    """
    return suffix_sums(stash(histogram(docs, text_col, vocab), "lengths"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens that remain if every text is cut at ``limit``."""
    r = sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").first()
    if r is None:
        r = sums.first()
        return r["total_tokens"] if r else 0
    return r["total_tokens"] - r["tokens_ge"] + limit * r["docs_ge"]


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that a share q of the texts does not exceed."""
    r = sums.where(F.col("docs_le") >= F.greatest(F.lit(1.0), F.ceil(F.lit(q) * F.col("total_docs")))).orderBy("n_tokens").first()
    return r["n_tokens"] if r else None
