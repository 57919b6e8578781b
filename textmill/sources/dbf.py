"""dBASE III files with memo files, read and written in parallel.

Records and memo blocks have fixed widths, so both files are read in byte
ranges (see ``ranges``) on any file system, and records meet the blocks of
their memos in a join on the block's number. Every field is a string. A table
may be several files, each with a memo file of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.sources.ranges import fixed_records
from textmill.workers import reach

MEMO_BLOCK, MEMO_END, HEADER_END, DELETED = 512, 0x1A, 0x0D, 0x2A


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    start: int
    width: int


@dataclass(frozen=True)
class Layout:
    records: int
    header: int
    width: int
    fields: tuple[Field, ...]

    @classmethod
    def of(cls, head: bytes) -> Layout:
        """The layout that a file's head tells; see ``head_of``."""
        records, header, width = struct.unpack("<4xIHH20x", head[:32])
        fields, at = [], 1  # byte 0 of a record is its deletion mark
        for i in range(32, len(head) - 31, 32):
            d = head[i : i + 32]
            if d[0] == HEADER_END:
                break
            fields.append(Field(d[:11].split(b"\0")[0].decode("ascii", "replace").strip(), chr(d[11]), at, d[16]))
            at += d[16]
        return cls(records, header, width, tuple(fields))


def _open(spark: SparkSession, path: str, least: int) -> tuple[bytes, int]:
    """The first bytes of a file, and its length."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.open(own)
    try:
        return bytes(stream.readNBytes(least)), fs.getFileStatus(own).getLen()
    finally:
        stream.close()


def head_of(spark: SparkSession, path: str) -> tuple[bytes, int]:
    """A file's header, to the end of its fields, and the file's length."""
    first, length = _open(spark, path, 32)
    return _open(spark, path, max(32, min(length, struct.unpack("<8xH", first[:10])[0])))[0], length


def number_text(text: str) -> str:
    """A number field's text: integers of any length plainly, those with a
    point without end zeros; what is no number stays."""
    try:
        return str(float(text) if "." in text else int(text))
    except ValueError:
        return text


def field_text(raw: bytes, kind: str, encoding: str = "cp850") -> str:
    """A field as text; of a memo field, the number of its first block."""
    whole = raw.decode(encoding, "replace")
    text = whole.strip()
    if kind == "N":
        return number_text(text)
    if kind == "D":
        return f"{text[:4]}-{text[4:6]}-{text[6:8]}" if len(text) == 8 and text.isdigit() else ""
    if kind == "L":
        return "True" if text.upper() in ("T", "Y") else "False" if text.upper() in ("F", "N") else ""
    if kind == "M":
        return text if text.isascii() and text.isdigit() else ""
    return whole.rstrip()  # blanks before a text are part of it


def memos(spark: SparkSession, path: str, starts: DataFrame, encoding: str = "cp850") -> DataFrame:
    """file, block, text of the memos that start at the given (file, block):
    from there to the end mark, or to the file's end. A memo's last block is
    the next one that has a mark, so only blocks of memos asked for are met."""
    length_of = lambda f: _open(spark, f, 0)[1]
    blocks = fixed_records(spark, path, lambda files: {f: (i, 0, MEMO_BLOCK, length_of(f)) for i, f in enumerate(sorted(files))})
    ends = F.hex("record").rlike(f"^(?:..)*?{MEMO_END:02X}")  # a whole byte: an even number of digits before
    marked = blocks.select("file", "no", ends.alias("ends"))
    down = Window.partitionBy("file").orderBy(F.desc("no")).rowsBetween(Window.unboundedPreceding, 0)
    last = marked.select("file", "no", F.last(F.when(F.col("ends"), F.col("no")), ignorenulls=True).over(down).alias("end"), F.max("no").over(Window.partitionBy("file")).alias("most"))
    spans = starts.join(last, (starts["file"] == last["file"]) & (starts["block"] == last["no"])).select(starts["file"], "block", F.explode(F.sequence("block", F.coalesce("end", "most"))).alias("no"))
    whole = spans.join(blocks, ["file", "no"]).groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("no", "record"))).alias("p"))
    raw = whole.select("file", "block", F.aggregate("p", F.lit(b""), lambda acc, p: F.concat(acc, p["record"])).alias("raw"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [r.split(bytes([MEMO_END]), 1)[0].decode(encoding, "replace").strip() for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["file", "block", "text"])

    return raw.mapInArrow(decode, "file int, block bigint, text string")


def read(spark: SparkSession, path: str, memo: str = "", encoding: str = "cp850") -> DataFrame:
    """The records of a table that aren't deleted, a string column per field;
    a truncated last record is none. ``path`` and ``memo`` name a file or a
    folder each; of several, the n-th of both in order of name belong together.
    Memo fields without a memo file, or without a block in it, are empty."""
    reach(spark)
    seen: dict[str, Layout] = {}

    def layouts(files: dict[str, int]) -> dict[str, tuple[int, int, int, int]]:
        out = {}
        for i, f in enumerate(sorted(files)):
            head, length = head_of(spark, f)
            lay = seen.setdefault(f, Layout.of(head))
            out[f] = (i, lay.header, lay.width, min(length, lay.header + lay.records * lay.width))
        return out

    records = fixed_records(spark, path, layouts)
    if len({lay.fields for lay in seen.values()}) != 1:
        raise ValueError(f"{len(seen)} files, of different fields" if seen else f"no table at {path}")
    lay = next(iter(seen.values()))
    names = [f.name for f in lay.fields]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(i, r) for i, r in enumerate(b.column(2).to_pylist()) if len(r) == lay.width and r[0] != DELETED]
            cols = [pa.array([field_text(r[f.start : f.start + f.width], f.kind, encoding) for _, r in kept], pa.string()) for f in lay.fields]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in kept], pa.int64())), b.column(1).take(pa.array([i for i, _ in kept], pa.int64())), *cols], names=["_file", "_no", *names])

    rows = records.mapInArrow(decode, "_file int, _no bigint, " + ", ".join(f"`{n}` string" for n in names))
    for name in (f.name for f in lay.fields if f.kind == "M"):
        if not memo:
            rows = rows.withColumn(name, F.lit(""))
            continue
        block = F.col(name).try_cast("bigint")
        starts = rows.select(F.col("_file").alias("file"), block.alias("block")).where("block > 0").distinct()
        texts = memos(spark, memo, starts, encoding).select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("text").alias("_text"))
        rows = rows.withColumn("_block", block).join(texts, ["_file", "_block"], "left").withColumn(name, F.coalesce("_text", F.lit(""))).drop("_block", "_text")
    return rows.select(*names)


def _memo_blocks(raw: bytes) -> int:
    """Blocks of a memo with its end mark and one byte of padding at least."""
    return -(-(len(raw) + 2) // MEMO_BLOCK) if raw else 0


def write(df: DataFrame, fields: list[tuple[str, str, int]], path: str, memo: str = "", parts: int = 1, encoding: str = "cp850") -> None:
    """A table of ``parts`` files (name, kind, width per field; columns of
    these names, as text), its memos in as many memo files. Each part is
    written by a task, in order of its rows' hashes: a file is a header and
    records, and as a record starts with a blank, that is the separator with
    which Spark's text writer ends the header and each record before it."""
    spark = df.sparkSession
    reach(spark)
    names, kinds = [n for n, _, _ in fields], {n: k for n, k, _ in fields}
    width = 1 + sum(w for _, _, w in fields)
    cols = [F.coalesce(F.col(n), F.lit("")).alias(n) for n in names]
    key = F.xxhash64(*names)
    rows = df.select(*cols, F.pmod(key, F.lit(parts)).cast("int").alias("_part"), key.alias("_key"))
    sized = [n for n in names if kinds[n] == "M"]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the blocks of each memo."""
        for b in batches:
            found = [pa.array([_memo_blocks(t.encode(encoding, "replace")) for t in b.column(n).to_pylist()], pa.int64()) for n in sized]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, *(f"_{i}" for i in range(len(sized)))])

    kind = ", ".join(f"`{n}` string" for n in names) + ", _part int, _key bigint" + "".join(f", _{i} bigint" for i in range(len(sized)))
    rows = rows.mapInArrow(sizes, kind)
    order = Window.partitionBy("_part").orderBy("_key", *names)
    all_blocks = sum((F.col(f"_{i}") for i in range(len(sized))), F.lit(0))
    rows = rows.withColumn("_row", F.row_number().over(order)).withColumn("_at", F.sum(all_blocks).over(order.rowsBetween(Window.unboundedPreceding, 0)) - all_blocks + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                at, record, blocks = r["_at"], b"", []
                for n, k, w in fields:
                    text = r[n]
                    if k == "M":
                        raw = text.encode(encoding, "replace")
                        text, size, raw = str(at) if raw else "", _memo_blocks(raw), raw + bytes([MEMO_END]) if raw else b""
                        at += size
                        blocks.append(raw.ljust(size * MEMO_BLOCK, b"\0"))
                    record += text.encode(encoding, "replace")[:w].ljust(w)
                out.append((r["_part"], r["_row"], record, b"".join(blocks)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "row", "record", "memo"])

    coded = rows.mapInArrow(encode, "part int, row bigint, record binary, memo binary")
    tail = b"".join(struct.pack("<11sc4xB15x", n.encode(), k.encode(), w) for n, k, w in fields) + bytes([HEADER_END])
    counts = coded.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(counts, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))
    little = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright("n", 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]))
    head = F.concat(F.lit(struct.pack("<B3s", 3, b"\0\0\0")), little, F.lit(struct.pack("<HH20s", 32 + len(tail), width, b"") + tail))

    def put(body: DataFrame, to: str, sep: str) -> None:
        own = body.repartition(parts, "part").sortWithinPartitions("part", "row").select("part", F.col("raw").cast("string").alias("value"))
        own.write.mode("overwrite").partitionBy("part").option("lineSep", sep).text(to)

    put(every.select("part", F.lit(0).cast("long").alias("row"), head.alias("raw")).unionByName(coded.select("part", "row", F.col("record").alias("raw"))), path, " ")
    if memo:
        less = F.substring(F.col("memo"), F.lit(1), F.octet_length("memo") - 1)  # a memo's last byte is the separator
        first = every.select("part", F.lit(0).cast("long").alias("row"), F.lit(b"\0" * (MEMO_BLOCK - 1)).alias("raw"))
        put(first.unionByName(coded.where(F.octet_length("memo") > 0).select("part", "row", less.alias("raw"))), memo, "\0")


def stats(spark: SparkSession, path: str, loaded: int) -> dict[str, object]:
    """records_total, records_loaded, records_deleted and the field names."""
    lay = Layout.of(head_of(spark, path)[0])
    return {"records_total": lay.records, "records_loaded": loaded, "records_deleted": lay.records - loaded, "fields": [f.name for f in lay.fields]}
