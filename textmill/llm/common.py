"""Helpers shared by the training-data operators.

Texts travel to Python as UTF-8 ``binary`` columns: the word rules of this
subpackage are byte rules (ASCII white space, A-Z lower-casing), so no decode
is needed, and ``bytes.split()`` splits exactly on ``[\\x20\\x09-\\x0D]+``.
Where characters count, ``decoded`` reads them: malformed UTF-8, which a string
column may hold, becomes U+FFFD there and stops no operator.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.bitset import broadcast_cells, held
from textmill.workers import reach

#: Keys of more than one in so many rows are joined by broadcast.
HOT = 1000
#: Bits of the set that holds back rows of other ids, a power of two (16 MB).
ID_BITS = 27

_own_folder: str | None = None
_scope = threading.local()


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that a worker holds few texts at once."""
    reach(spark)


def decoded(raw: bytes) -> str:
    """The characters of UTF-8 bytes, malformed ones as U+FFFD."""
    return raw.decode("utf-8", "replace")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, an own folder is made on one machine; on a cluster
    that raises, since executors don't see each other's folders.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="textmill-")
        atexit.register(shutil.rmtree, _own_folder, True)
    return "file://" + _own_folder


def _stash_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/textmill/{spark.sparkContext.applicationId}"


def clear_stash(spark: SparkSession) -> None:
    """Deletes the application's stashed tables. Results that still read them
    must have been written before."""
    _delete(spark, _stash_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, tag: str, by: str | None = None, buckets: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and reread it. With
    ``by``, in so many buckets of that column: grouped by it, it is not
    shuffled again.

    This cuts the lineage, keeps costly Python stages from running twice (an
    RDD checkpoint runs its last stage twice) and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{_stash_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    if by is not None:
        table = f"textmill_{uuid.uuid4().hex}"
        df.repartition(buckets, by).write.bucketBy(buckets, by).saveAsTable(table, "parquet", path=path, compression="zstd")
    else:
        df.write.parquet(path, compression="zstd")
    if (paths := getattr(_scope, "paths", None)) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path) if by is None else spark.table(table)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and broadcasts of jobs that are done, now:
    its cleaner waits until Python and the driver's JVM have collected what
    refers to them. Arrow's free memory goes back too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were stashed within it, but for the
    last one: for work whose last step stashes what it has made."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
        for p in _scope.paths[:-1]:
            _delete(spark, p)
    finally:
        if outer is not None:
            outer += _scope.paths[-1:]
        _scope.paths = outer


def split_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def unit_of(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit("sample"), doc_id), F.lit(1 << 40)).cast("double") / float(1 << 40)


def by_value(rates: dict, key: Column, other: float = 0.0) -> Column:
    """The rate of the key's value; ``other`` for values that aren't there."""
    if not rates:
        return F.lit(other)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for r in rates.items() for v in r]), key), F.lit(other))


def sample_ids(rows: DataFrame, id_col: str, group_col: str | None, per_group: float) -> DataFrame:
    """About ``per_group`` rows of each group, chosen by the hash of their id.

    Membership depends on ids alone, so it is the same on every run and split.
    The groups (languages, labels), but no rows, are counted on the driver.
    """
    if group_col is None:
        return rows.where(unit_of(F.col(id_col)) < per_group / max(1, rows.count()))
    sizes = rows.where(F.col(group_col).isNotNull()).groupBy(group_col).count().collect()
    return rows.where(unit_of(F.col(id_col)) < by_value({r[0]: per_group / r[1] for r in sizes}, F.col(group_col)))


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """The least text of each key: an id that is repeated teaches once, so a
    sample of ids bounds the texts."""
    return rows.groupBy(*keys).agg(F.min("text").alias("text"))


def rows_of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the given ids, of which there may be any number: a set of
    bits holds back nearly all others, so that of the texts in ``rows`` about
    those of the ids are shuffled to them."""
    ids = ids.select(F.col(key).cast(rows.schema[key].dataType).alias(key)).where(F.col(key).isNotNull())
    cell, name = F.shiftrightunsigned(F.xxhash64(key), 64 - ID_BITS), fresh("_cell", rows)
    bits = broadcast_cells(ids.select(cell.alias("cell")), 1 << ID_BITS)
    maybe = keep_rows(rows.withColumn(name, cell), lambda cells: held(bits.value, np.array(cells, np.int64)), name)
    return maybe.drop(name).join(ids, key, "left_semi")


def with_key_rows(rows: DataFrame, keys: list[str], values: DataFrame, total: int) -> DataFrame:
    """``rows``, of which there are ``total``, joined to the values of their
    keys; values: a row per key, with n, how many rows the key has."""
    often = total // HOT
    hot = F.broadcast(values.where(F.col("n") > often))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(values.where(F.col("n") <= often), keys)
    return rows.join(hot, keys).unionByName(rest)


def fresh(name: str, df: DataFrame) -> str:
    """The name, with underscores until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def keep_rows(docs: DataFrame, keep, *needed: str) -> DataFrame:
    """The rows of ``docs``, all columns, for which ``keep(*lists)`` says true.

    The rows pass through the task that judges them, so nothing is joined or
    shuffled. Strings come as bytes. ``keep`` gets a list per needed column.
    """
    prepare(docs.sparkSession)
    at = [docs.columns.index(c) for c in needed]

    def run(batches):
        for b in batches:
            cols = [b.column(i) for i in at]
            lists = [(c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in cols]
            yield b.filter(pa.array(keep(*lists), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
