"""From raw documents to packed training sequences, stage by stage.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

In every stage, null and empty texts, null ids and repeated rows are rows like
others, very long texts are read whole, an empty table gives an empty result,
and columns beside those of documents go through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import decontaminate, near_dedup, packing, perplexity, toxicity
from textmill.llm.common import passing_tables, stash


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scored below the threshold; a null or empty text has the
    model's least score and stays. Copies go or stay together."""
    return toxicity.drop_toxic(docs, _read(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents within their language's limit, a perplexity at the limit
    included; a null or empty text is judged by its end alone, a null language
    by the limit of all."""
    return perplexity.keep_good(docs, _read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group; null, empty and wordless
    texts are one group; of rows that repeat an id and text, one stays."""
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth of the words stands in a
    benchmark window; texts without words stay."""
    return decontaminate.remove_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place; a null or empty text is one piece of its
    end alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Models, 64-bit SimHash and token ids are not expressible in SQL; the tests
#: hold run() against brute-force versions of the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has stashed, and its input, are
    deleted once its output is written; the result reads the last tables."""
    docs = _read(spark, sf_dir, "documents")
    with passing_tables(spark):
        for name, stage in STAGES[:-1]:
            with passing_tables(spark):
                docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
