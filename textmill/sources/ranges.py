"""Ranges of files: parallel reading of what a range alone can't tell.

Spark's text reader deals a file to tasks in byte ranges, cut at a separator,
on any file system. What a range can't know (at which byte it starts, whether
it starts inside quotes) is a sum over the ranges before it: a first pass sums
per range, and a second one, given the sums, cuts the records. Only what
crosses the border of two ranges is shuffled and put together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.workers import BATCH_BYTES, BATCH_ROWS, reach

#: Ranges whose sums are broadcast, about 200 bytes each.
RANGES = 1_000_000
WHOLE, OPEN, MORE = 0, 1, 2


def lines(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """file, range (its first byte), line (binary): in order within a range."""
    raw = spark.read.option("lineSep", sep).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("line"))


def sums_before(rows: DataFrame, **what: Column) -> dict[tuple[str, int], tuple[int, ...]]:
    """Of each (file, range), the sums over the file's ranges before it."""
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file", "range").agg(*[F.sum(c).alias(n) for n, c in what.items()])
    got = sums.select("file", "range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in what]).limit(RANGES + 1).toArrow()
    if got.num_rows > RANGES:
        raise ValueError(f"more than {RANGES} ranges; read them in larger ones (spark.sql.files.maxPartitionBytes)")
    return {(f, r): tuple(s) for f, r, *s in zip(*(c.to_pylist() for c in got.columns), strict=True)}


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """((file, range), lines): each batch of ``lines`` cut where the range
    changes."""
    for b in batches:
        if not b.num_rows:
            continue
        start, file = np.asarray(b.column(1)), b.column(0)
        codes = np.asarray(pc.dictionary_encode(file).indices)
        at = np.flatnonzero((start[1:] != start[:-1]) | (codes[1:] != codes[:-1])) + 1
        for i, j in zip([0, *at.tolist()], [*at.tolist(), b.num_rows], strict=True):
            yield (file[i].as_py(), int(start[i])), b.column(2).slice(i, j - i)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """no (from 1), line: the lines with their numbers, which go on from file
    to file in order of name."""
    reach(spark)
    own = lines(spark, path)
    got = own.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n")).limit(RANGES + 1).collect()
    if len(got) > RANGES:
        raise ValueError(f"more than {RANGES} ranges; read them in larger ones (spark.sql.files.maxPartitionBytes)")
    before, first = {}, 1
    for r in sorted(got, key=lambda r: (r["file"], r["range"])):
        before[r["file"], r["range"]], first = first, first + r["n"]
    known = spark.sparkContext.broadcast(before)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, no = None, 0
        for k, part in runs(batches):
            key, no = k, no if k == key else known.value[k]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(no, no + len(part))), part.cast(pa.binary())], names=["no", "line"])
            no += len(part)

    return own.mapInArrow(number, "no bigint, line binary").select("no", F.col("line").cast("string").alias("line"))


def _quotes() -> Column:
    text = F.col("line").cast("string")
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """file, at, record: the records of files of lines in which a field in
    double quotes (doubled inside it) may hold newlines. ``at`` orders a file's
    records, and is 0 for its first. A quote that never ends takes the rest of
    its file; quotes inside a field without them count like others."""
    reach(spark)
    own = lines(spark, path)
    known = spark.sparkContext.broadcast(sums_before(own, size=F.octet_length("line") + 1, quotes=_quotes()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, inside, held, begun, held_at, made, size = None, 0, 0, [], False, 0, [], 0

        def row(kind: int) -> Iterator[pa.RecordBatch]:
            """The held lines are a record; records go out many at a time."""
            nonlocal size
            made.append((held_at, kind, b"\n".join(held)))
            size += len(made[-1][2])
            if size >= BATCH_BYTES or len(made) >= BATCH_ROWS:
                yield from out()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            if made:
                places, kinds, records = zip(*made, strict=True)
                yield _rows(key[0], list(places), list(kinds), pa.array(records, pa.binary()))
            made, size = [], 0

        for k, part in runs(batches):
            if k != key:
                if held:
                    yield from row(OPEN if begun else MORE)
                yield from out()
                key, (at, inside), held, begun = k, known.value[k], [], False
                inside &= 1
            sizes = np.asarray(pc.binary_length(part)).astype(np.int64) + 1
            place = at + np.cumsum(sizes) - sizes
            after = (inside + np.cumsum(np.asarray(pc.count_substring(part.cast(pa.binary()).view(pa.string()), '"')).astype(np.int64))) & 1
            before = np.concatenate([[inside], after[:-1]])
            one = (before == 0) & (after == 0)
            if one.any():
                yield _rows(key[0], place[one], np.zeros(int(one.sum()), np.int64), part.filter(pa.array(one)))
            for i in np.flatnonzero(~one).tolist():
                if not held:
                    held_at, begun = int(place[i]), not before[i]
                held.append(part[i].as_py())
                if not after[i]:
                    yield from row(WHOLE if begun else MORE)
                    held, begun = [], False
            at, inside = int(at + sizes.sum()), int(after[-1])
        if held:
            yield from row(OPEN if begun else MORE)
        yield from out()

    pieces = own.mapInArrow(cut, "file string, at bigint, kind int, record binary").withColumn("record", F.col("record").cast("string"))
    chain = F.count_if(F.col("kind") == OPEN).over(Window.partitionBy("file").orderBy("at", "kind"))
    borders = pieces.where(F.col("kind") != WHOLE).withColumn("chain", chain)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "record"))), lambda p: p["record"]), "\n")
    put = borders.groupBy("file", "chain").agg(F.min("at").alias("at"), joined.alias("record")).drop("chain")
    return pieces.where(F.col("kind") == WHOLE).drop("kind").unionByName(put)


def _rows(file: str, at, kind, record: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(record), pa.string()), pa.array(at, pa.int64()), pa.array(kind, pa.int32()), record.cast(pa.binary())], names=["file", "at", "kind", "record"])


def joined_bytes(part: pa.Array, sep: int) -> bytes:
    """The lines' bytes, each with the separator after it."""
    sizes = np.asarray(pc.binary_length(part)).astype(np.int64)
    part = part.cast(pa.binary())
    raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)
    first = int(np.frombuffer(part.buffers()[1], np.int32)[part.offset])
    out = np.full(int(sizes.sum()) + len(sizes), sep, np.uint8)
    out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = raw[first : first + int(sizes.sum())]
    return out.tobytes()


def fixed_records(spark: SparkSession, path: str, layout: Callable[[dict[str, int]], dict[str, tuple[int, int, int, int]]], sep: str = " ") -> DataFrame:
    """file (number), no, record: records of fixed width. ``layout`` is told
    the files and gives of each: its number, the first record's byte, the
    width, and the byte where records end. The last record of a file may be
    shorter. ``sep`` is a byte that the files hold often."""
    reach(spark)
    own = lines(spark, path, sep)
    before = sums_before(own, size=F.octet_length("line") + 1)
    layouts = layout(dict.fromkeys(f for f, _ in before))
    known = spark.sparkContext.broadcast((before, layouts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, of_file = known.value
        key, at, left = None, 0, b""

        def rows(end: bool) -> Iterator[pa.RecordBatch]:
            """What ``left``, whose first byte is number ``at``, holds whole;
            with ``end`` all of it."""
            nonlocal at, left
            number, first, width, stop = of_file[key[0]]
            skip = max(0, min(len(left), first - at))
            at, left = at + skip, left[skip:]
            left = left[: max(0, stop - at)] if at + len(left) > stop else left
            if not left or at < first:
                return
            no, into = divmod(at - first, width)
            nos, places, found, took = [], [], [], 0
            if into:
                if len(left) < width - into and not end:
                    return
                took = min(len(left), width - into)
                nos, places, found = [no], [at], [left[:took]]
                no += 1
            n = (len(left) - took) // width
            nos += range(no, no + n)
            places += range(at + took, at + took + n * width, width)
            found += [left[i : i + width] for i in range(took, took + n * width, width)]
            took += n * width
            if end and took < len(left):
                nos, places, found, took = [*nos, no + n], [*places, at + took], [*found, left[took:]], len(left)
            whole = [len(f) == width for f in found]
            at, left = at + took, left[took:]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int32()), pa.array(nos, pa.int64()), pa.array(places, pa.int64()), pa.array(whole), pa.array(found, pa.binary())], names=["file", "no", "at", "whole", "record"])

        for k, part in runs(batches):
            if k != key:
                if key is not None:
                    yield from rows(True)
                key, at, left = k, offsets[k][0], b""
            left += joined_bytes(part, ord(sep))
            yield from rows(False)
        if key is not None:
            yield from rows(True)

    pieces = own.mapInArrow(cut, "file int, no bigint, at bigint, whole boolean, record binary")
    parts = pieces.where("not whole").groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("at", "record"))).alias("p"))
    put = F.aggregate("p", F.lit(b""), lambda acc, p: F.concat(acc, p["record"]))
    return pieces.where("whole").select("file", "no", "record").unionByName(parts.select("file", "no", put.alias("record")))
