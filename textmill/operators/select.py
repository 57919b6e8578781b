"""Exact order statistics by counting in narrowing ranges.

A percentile is a value of a known rank. Values are summed up to (value,
count); then each round cuts every range that holds a wanted rank into equal
parts, counts the values in each, and keeps the part with the rank, until few
values are left in it. A task holds counts of parts, or those few values, never
the values of a key, however many there are and whatever their distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.storage import written

#: Parts of a range in a round; different values that are put in order at last.
PARTS, FEW = 1024, 10_000
#: Ranges (wanted ranks of all keys) that are broadcast, about 100 bytes each.
RANGES = 200_000


def finite(value: Column) -> Column:
    """The value as a double; null for NaN and the infinite."""
    v = value.cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def _met(counts: DataFrame, ranges: DataFrame) -> DataFrame:
    """The values inside each range."""
    small = ranges.count() <= RANGES
    return counts.join(F.broadcast(ranges) if small else ranges, "key").where(F.col("v").between(F.col("lo"), F.col("hi")))


def percentiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """key (a struct of ``keys``) and, per name, the percentile of that share,
    between two values by their distance; nulls, NaN and the infinite count as
    missing. Keys without a value have no row; null keys are one."""
    key = F.struct(*keys) if keys else F.struct(F.lit(1).alias("all"))
    counts = written(rows.select(key.alias("key"), finite(F.col(value)).alias("v")).where("v is not null").groupBy("key", "v").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = {n: (F.col("total") - 1) * F.lit(q) for n, q in at.items()}
    wanted = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    ranges = written(sizes.select("key", "lo", "hi", "inside", F.lit(0).cast("long").alias("below"), F.explode(wanted).alias("rank")))
    wide = (F.col("inside") > FEW) & (F.col("lo") < F.col("hi"))
    of_rank = Window.partitionBy("key", "rank")
    holds = (F.col("end") > F.col("rank")) & (F.col("end") - F.col("n") <= F.col("rank"))
    while not (todo := ranges.where(wide)).isEmpty():
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1))
        parts = _met(counts, todo.drop("inside")).groupBy("key", "rank", "below", part.alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        parts = parts.withColumn("end", F.col("below") + F.sum("n").over(of_rank.orderBy("part")))
        narrower = parts.where(holds).select("key", "lo", "hi", "inside", (F.col("end") - F.col("n")).alias("below"), "rank")
        ranges = written(ranges.where(~wide).unionByName(narrower))
    found = _met(counts, ranges.drop("inside")).withColumn("end", F.col("below") + F.sum("n").over(of_rank.orderBy("v"))).where(holds)
    values = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of")).join(sizes.select("key", "total"), "key")

    def between(p: Column) -> Column:
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        return F.when(low == high, F.col("of")[low]).otherwise((high - p) * F.col("of")[low] + (p - low) * F.col("of")[high])

    return values.select("key", *[between(p).alias(n) for n, p in place.items()])
