"""Writers. Row counts come from an observation of the write itself."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import slug
from textmill.operators.retrieve import bm25_blocks, bm25_of_rows, bm25_tables


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """JSON lines, UTF-8; returns the number of rows written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def write_silver_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns, which CSV can't hold, are left out.
    Quotes are doubled, as the readers expect, and outer blanks stay; null is
    an empty field, and an empty text two quotes."""
    flat = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "struct", "map")]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_index(chunks: DataFrame, path: str, reset: bool = False) -> None:
    """The vector table of a variant, partitioned by source; ``reset``
    replaces it, else rows are added."""
    chunks.write.mode("overwrite" if reset else "append").partitionBy("source_type").parquet(path)


def _blocks_table(path: str, buckets: int) -> str:
    return f"lexical_{crc32(path.encode()):08x}_{buckets}"


#: By the table that an index is searched in: its other tables, and the keys
#: that it is bucketed by.
_LEXICAL = {"blocks": (("postings", "docs", "terms", "stats"), ("term", "part")), "rows": (("terms", "stats"), ("id",))}


def write_lexical_index(index: dict[str, DataFrame], path: str, buckets: int = 0) -> None:
    """The tables of a lexical index; texts are cut into terms for the first
    two, and the others are made of these as they are stored. With ``buckets``
    the blocks of postings become a catalog table bucketed by term and part,
    or the rows one bucketed by id, whose number of buckets is kept beside it,
    so that any session can read it as bucketed."""
    spark = index["terms"].sparkSession

    def put(name: str) -> DataFrame:
        index[name].write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    def put_main(name: str, df: DataFrame) -> DataFrame:
        if not buckets:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")
        by = _LEXICAL[name][1]
        df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).option("path", f"{path}/{name}").saveAsTable(_blocks_table(path, buckets))
        return spark.table(_blocks_table(path, buckets))

    if "rows" in index:
        index = bm25_of_rows(put_main("rows", index["rows"]))
        for name in _LEXICAL["rows"][0]:
            put(name)
    else:
        index = index | bm25_tables(put("postings"), put("docs"))
        index = index | {name: put(name) for name in ("terms", "stats")}
        put_main("blocks", bm25_blocks(index))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


def read_lexical_index(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The index that ``write_lexical_index`` has written; None without one. A
    bucketed table is read through the catalog (a session that doesn't know it
    is told of it), so that joins on its keys need no exchange of it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/layout")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    main = "rows" if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder.getParent().suffix("/rows")) else "blocks"
    index = {name: spark.read.parquet(f"{path}/{name}") for name in (*_LEXICAL[main][0], main)}
    if buckets := spark.read.parquet(f"{path}/layout").first()["buckets"]:
        name, columns, by = _blocks_table(path, buckets), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index[main].schema), ", ".join(_LEXICAL[main][1])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/{main}'")
        spark.catalog.refreshTable(name)
        index[main] = spark.table(name)
    return index


def _file_system(spark: SparkSession, path: str) -> tuple:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _next_append(spark: SparkSession, path: str) -> int:
    """Claims the log's next number: the one that makes the claim's file has
    it, whoever else appends."""
    claims, fs = _file_system(spark, f"{path}/_claims")
    fs.mkdirs(claims)
    n = max((int(f.getPath().getName()) for f in fs.listStatus(claims)), default=0) + 1
    while not fs.createNewFile(claims.suffix(f"/{n}")):
        n += 1
    return n


def append_cache(df: DataFrame, path: str) -> int:
    """Adds newly computed entries to a log and returns the append's number;
    what a stopped run had appended stays. Each append is a folder of its
    number, and each entry has its line in it, so that the readers know the
    order whatever the sizes of the files. Lines follow the order of ``df``."""
    n = _next_append(df.sparkSession, path)
    df.withColumn("line", F.monotonically_increasing_id()).write.mode("overwrite").json(f"{path}/append={n:09d}")
    return n


def compact_cache(latest: DataFrame, path: str) -> None:
    """Replaces the log by ``latest``, its entries as a reader gives them: they
    become one append more, and once that is written the earlier ones go."""
    spark = latest.sparkSession
    n = append_cache(latest, path)
    root, fs = _file_system(spark, path)
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("append=") and int(name[7:]) < n:
            fs.delete(f.getPath(), True)


def write_scores(scores: DataFrame, path: str, **metadata: object) -> None:
    """A row per question as JSON lines in the folder ``scores``, and the
    metadata as one row beside it, in ``metadata``."""
    scores.write.mode("overwrite").json(f"{path}/scores")
    head = scores.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in metadata.items()] or [F.lit(None).cast("string").alias("none")])
    head.write.mode("overwrite").json(f"{path}/metadata")


def write_consolidated(answers: DataFrame, path: str) -> None:
    """One row per question with its answers by variant."""
    answers.write.mode("overwrite").json(path)


def write_query_artifact(answers: DataFrame, folder: str, timestamp: str) -> None:
    """Answered queries as JSON, in a folder per query: time and slug."""
    named = answers.withColumn("artifact", F.concat(F.lit(f"{timestamp}_"), slug(F.col("query"))))
    named.write.mode("append").partitionBy("artifact").json(folder)


def backup_once(df: DataFrame, path: str) -> None:
    """Keeps a copy unless one is there already."""
    df.write.mode("ignore").parquet(path)


def markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small aggregate as a Markdown table; nulls are dashes. A table of
    more than ``most`` rows is no report and raises."""
    show = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"
