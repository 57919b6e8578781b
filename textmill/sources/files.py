"""Readers of exports, documents, question sets, bundles and caches."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textmill import schemas
from textmill.functions.text import is_blank
from textmill.sources.ranges import numbered_lines, quoted_records
from textmill.workers import reach

# The columns used of a forum export (ordinals) and of tickets.
FORUM_WIDTH = 26
FORUM_COLUMNS = {"post_id": 0, "topic_id": 1, "forum_id": 2, "post_time": 6, "post_subject": 14, "post_text": 15}
TICKET_COLUMNS = ("ID", "KATEGORIE", "VERSION", "VERSIONERL", "BESCHREIBU", "PRODUKTID", "FEHLER", "LOESUNG", "STATUSID", "BEARBEITET")
CATEGORIES = ("Chunking", "Recency", "Visuals", "CrossSource")


def sampled(df: DataFrame, key: str, n: int | None, seed: int = 42) -> DataFrame:
    """n rows by the hash of their key: the same rows on every run."""
    return df if n is None else df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """file, at, record of a quoted CSV, read in ranges; blank lines go. Bytes
    that are no UTF-8 raise when the row is read: the export is mis-encoded."""
    own = quoted_records(spark, path).withColumn("record", F.validate_utf8("record"))
    text = F.regexp_replace(F.when(F.col("at") == 0, F.ltrim(F.col("record"), F.lit("\ufeff"))).otherwise(F.col("record")), "\r$", "")
    return own.select("file", "at", text.alias("record")).where("record <> ''")


def fields_of(record: str, sep: str) -> list[str | None]:
    """The fields of a CSV record. An empty one is null, and an empty text if
    it is in quotes. A quoted one ends at the first quote that isn't doubled,
    or with the record; with more than blanks between that and the separator
    its quotes are text like any other, and so is a quote at the very end."""
    fields, at = [], 0
    while True:
        end = at
        if record.startswith('"', at) and at + 1 < len(record):
            end = record.find('"', at + 1)
            while end >= 0 and record.startswith('"', end + 1):
                end = record.find('"', end + 2)
            end = len(record) if end < 0 else end
        stop = record.find(sep, end)
        stop = len(record) if stop < 0 else stop
        if end > at and not record[end + 1 : stop].strip(" \t"):
            fields.append(record[at + 1 : end].replace('""', '"'))
        else:
            fields.append(record[at:stop] or None)
        if stop == len(record):
            return fields
        at = stop + len(sep)


def _fields(records: DataFrame, sep: str) -> DataFrame:
    """file, at, fields (texts or nulls) of ``_records``. Spark's own parser
    makes null of an empty text in quotes, drops the character U+0000 in
    quotes, and ends a record at U+FFFF."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fields_of(r, sep) for r in b.column(2).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array([f for r in rows for f in r], pa.string()))], names=["file", "at", "fields"])

    return records.select("file", "at", "record").mapInArrow(cut, "file string, at bigint, fields array<string>")


def forum_csv(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """Posts of a headerless ``;`` export: six named columns and src_pos, which
    is in order of file name and place in the file.

    Rows without a numeric post id (torn multi-line fields) go; a post time
    that isn't a number is 0. Rows with too many columns go, short ones are
    filled with nulls. Files are read in byte ranges, quoted newlines or not.
    """
    raw = _fields(_records(spark, path), ";").where(F.size("fields") <= FORUM_WIDTH)
    posts = raw.select(*[F.get("fields", F.lit(i)).alias(n) for n, i in FORUM_COLUMNS.items()], F.struct("file", "at").alias("src_pos")).where(F.col("post_id").rlike(r"^\d+$"))
    return sampled(posts.withColumn("post_time", F.coalesce(F.col("post_time").try_cast("double").try_cast("long"), F.lit(0))), "post_id", sample)


def tickets_dbf(spark: SparkSession, path: str, memo: str, sample: int | None = None) -> DataFrame:
    """The ten ticket columns of a dBASE table; a missing one raises."""
    from textmill.sources import dbf

    return ticket_columns(dbf.read(spark, path, memo), sample)


def ticket_columns(df: DataFrame, sample: int | None = None) -> DataFrame:
    missing = [c for c in TICKET_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return sampled(df.select(*TICKET_COLUMNS), "ID", sample)


def tickets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tickets of a comma-separated export, each file with the same header; all
    strings. Files are read in byte ranges, quoted newlines or not."""
    rows = _records(spark, path)
    head = rows.where("at = 0").first()
    if head is None:
        raise ValueError(f"no header at {path}")
    names = next(csv.reader([head["record"]]))
    return _fields(rows.where("at > 0"), ",").select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])


def pdf_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, content of the PDF files of a folder, in order of path."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", str(recursive).lower())
    return read.load(folder).select("path", "content")


def pdf_pages(files: DataFrame, parser) -> DataFrame:
    """Documents of PDF files: doc_id, filename, pages, outline, images.

    ``parser(bytes)`` gives (page texts, [(level, title, page)], [(xref, page,
    width, height)]); no PDF library is needed to import this module. Images
    below 50 pixels on either side go, an image that is on several pages is
    taken where it comes first, and ids count per document.
    """
    import pyarrow as pa

    from textmill.functions.text import doc_id_of, normalize_page

    schema = "path string, texts array<string>, outline array<struct<level:int,title:string,page:int>>, shots array<struct<xref:int,page:int,width:int,height:int>>"

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts, toc, shots = parser(content)
                rows.append({"path": path, "texts": texts, "outline": [dict(zip(("level", "title", "page"), t, strict=True)) for t in toc], "shots": [dict(zip(("xref", "page", "width", "height"), s, strict=True)) for s in shots]})
            i32 = pa.int32()
            kinds = pa.schema([("path", pa.string()), ("texts", pa.list_(pa.string())), ("outline", pa.list_(pa.struct([("level", i32), ("title", pa.string()), ("page", i32)]))), ("shots", pa.list_(pa.struct([("xref", i32), ("page", i32), ("width", i32), ("height", i32)])))])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    reach(files.sparkSession)
    d = files.mapInArrow(run, schema)
    pages = F.transform("texts", lambda t, i: F.struct((i + 1).cast("int").alias("page_number"), normalize_page(t).alias("text")))
    return d.select(
        doc_id_of(F.col("path")).alias("doc_id"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        pages.alias("pages"),
        F.coalesce("outline", F.array()).alias("outline"),
        images_of("shots").alias("images"),
    )


def images_of(shots: str, least: int = 50) -> Column:
    """(image_id, page, width, height) of images in order of page, each xref
    once, none with a side below ``least``."""
    first = F.filter(shots, lambda s, i: ~F.exists(F.slice(shots, 1, i), lambda t: t["xref"] == s["xref"]) & (s["width"] >= least) & (s["height"] >= least))
    return F.transform(first, lambda s, i: F.struct(F.format_string("img_%03d", i + 1).alias("image_id"), s["page"].alias("page"), s["width"].alias("width"), s["height"].alias("height")))


def gold_jsonl(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents of JSON lines; blank lines and missing files are passed over."""
    there = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schemas.GOLD).json(there).where("doc_id is not null") if there else spark.createDataFrame([], schemas.GOLD)


def bundle_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A bundle in one part, or in a folder per batch."""
    return spark.read.schema(schemas.BUNDLE).json(path).where("question_id is not null").select(*schemas.BUNDLE.names)


def scores_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per question of what ``sinks.write_scores`` has written, or of
    a file of another writer with all in one object ({metadata, scores})."""
    if exists(spark, f"{path}/scores"):
        return spark.read.schema(schemas.SCORES).json(f"{path}/scores").select(F.col("_metadata.file_path").alias("file"), "*")
    raw = spark.read.option("multiLine", True).schema("scores array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schemas.SCORES) + ">>").json(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.inline("scores"))


def questions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Validated questions with their line number; of several files the
    numbers go on in order of name.

    The first violated rule of a line raises when the row is read, with the
    line's number.
    """
    raw = numbered_lines(spark, path).select("no", F.regexp_replace("line", "\r$", "").alias("line")).where(~is_blank(F.col("line")))
    parsed = F.try_parse_json("line")
    fields = [F.try_variant_get(parsed, f"$.{c}", "string").alias(c) for c in ("id", "question", "category", "ground_truth")]
    return validated(raw.select(F.col("no").cast("int").alias("line_no"), "line", *fields, parsed.isNull().alias("torn")))


def validated(rows: DataFrame) -> DataFrame:
    """rows: line_no, line, the four fields, torn. See ``questions_jsonl``."""
    where = F.concat(F.lit(" (line "), F.col("line_no").cast("string"), F.lit(")"))
    text = lambda c: F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), f"$.{c}", "variant"))
    fault = (
        F.when(F.col("torn"), "not JSON")
        .when(F.col("id").isNull() | F.col("question").isNull() | F.col("category").isNull(), "a required field is missing")
        .when(~F.col("id").rlike(r"^Q\d{3}$"), "the id isn't Q and three digits")
        .when(is_blank(F.col("question")) | (text("question") != "STRING"), "the question is empty")
        .when(~F.col("category").isin(*CATEGORIES), "unknown category")
        .when(text("ground_truth").isNotNull() & ~text("ground_truth").isin("STRING", "VOID"), "ground_truth isn't a string")
    )
    checked = F.when(fault.isNull(), F.col("id")).otherwise(F.raise_error(F.concat(fault, where)).cast("string"))
    return rows.select("line_no", checked.alias("id"), "question", "category", F.coalesce("ground_truth", F.lit("")).alias("ground_truth"))


def _in_order(df: DataFrame) -> DataFrame:
    """Adds ``at``, which orders the lines of an append log: the append, the
    line in it, and for lines that carry none (of other writers), the file's
    name, the place of the range that was read, and the row in it. Files are
    read in any order, so the number of a row alone says nothing."""
    append = F.coalesce(F.regexp_extract("_metadata.file_path", r"/append=(\d+)/", 1).try_cast("long"), F.lit(0))
    return df.withColumn("at", F.struct(append.alias("append"), F.coalesce("line", F.lit(-1)).alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("row")))


def keyword_cache(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, keywords: torn lines are passed over, the last entry wins
    (see ``sinks.append_cache``; a file of plain lines is a log, too)."""
    read = spark.read.schema("chunk_id string, keywords array<string>, line long, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true")
    raw = _in_order(read.json(path)).where("_corrupt is null and chunk_id is not null")
    return raw.groupBy("chunk_id").agg(F.max_by("keywords", "at").alias("keywords"))


def image_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last description of each image; a torn line raises."""
    read = spark.read.schema(StructType([*schemas.IMAGE_CACHE, StructField("line", LongType())])).option("mode", "FAILFAST").option("recursiveFileLookup", "true")
    last = F.max_by(F.struct("page", "width", "height", "vlm_description"), "at").alias("e")
    return _in_order(read.json(path)).groupBy("image_id").agg(last).select("image_id", "e.*")


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The greatest name among the files that match, or None."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((str(s.getPath()) for s in found), key=lambda p: p.rsplit("/", 1)[-1], default=None) if found else None


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
