"""SimHash near-duplicates by covering locality-sensitive hashing.

Every pair of fingerprints within the radius meets in some table, by
construction: each bit position gets a nonzero vector m(i) of radius+1 bits,
and the table of a nonzero vector v keeps the positions with <m(i), v> = 1.
Up to ``radius`` differing positions span a space of at most that dimension,
so some v is orthogonal to all of them and its mask ignores every difference.

Equal fingerprints are one node. A bucket yields a spanning forest of its
links, never all its pairs. A bucket of more than ``BUCKET`` different
fingerprints is covered a second time over the bits that its mask leaves
free, which bounds every group at 2**15 fingerprints, whatever the data.

What is said per fingerprint, bucket, hub or component is joined to its rows
by broadcast for the keys of more than a thousandth of the rows (so at most a
thousand keys), and by a shuffle for the others: no task gets the rows of a
hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import fresh, prepare, stash, with_key_rows

SEED = 42
RADIUS = 3
SHINGLE = 3
BUCKET = 4096
_ALL = (1 << 64) - 1


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text; 0 for null or no words."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        buf = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashes = [digest(buf[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): one row per row, the hash of the text and the
    fingerprint as a signed long."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "key", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, key bigint, fp bigint")


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """The 2**(radius+1)-1 masks over the given bit positions."""
    n = (1 << (radius + 1)) - 1
    vector = {p: 1 + i % n for i, p in enumerate(positions)}
    return [sum(1 << p for p, m in vector.items() if (m & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints."""
    rest, edges = values.view(np.uint64), []
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                stack.extend(found)
                edges.extend((int(np.int64(x.view(np.int64))), int(y)) for y in found.view(np.int64))
    return edges


def _edges_of(groups: DataFrame, radius: int) -> DataFrame:
    """(a, b) of forests; groups has one array column of different fps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            offsets, values = np.asarray(col.offsets), np.asarray(col.values)
            sizes, first = np.diff(offsets), offsets[:-1]
            two = first[sizes == 2]
            x, y = values[two], values[two + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            more = [e for i in np.flatnonzero(sizes > 2) for e in _forest(values[offsets[i] : offsets[i + 1]], radius)]
            a = np.concatenate([x[near], np.array([e[0] for e in more], np.int64)])
            c = np.concatenate([y[near], np.array([e[1] for e in more], np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], names=["a", "b"])

    return groups.mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a < b) that span the components of fingerprints within radius.

    fps: different fingerprints in column fp.
    """
    masks = covering_masks(list(range(64)), radius)
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "k"))
    sizes = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = with_key_rows(keys, ["t", "k"], sizes, len(masks) * fps.count())
    small = met.where(F.col("n") <= bucket).groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")
    finer = [[m | s for s in covering_masks([p for p in range(64) if not m >> p & 1], radius)] for m in masks]
    table = F.array(*[F.array(*[F.lit(_signed(x)) for x in row]) for row in finer])
    again = met.where(F.col("n") > bucket).select("fp", "t", F.posexplode(F.element_at(table, F.col("t") + 1)).alias("u", "mask"))
    large = again.groupBy("t", "u", F.col("fp").bitwiseAND(F.col("mask")).alias("k")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return _edges_of(small.unionByName(large), radius).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): every node of the links with its component's least node.

    Alternating large-star and small-star steps over aggregates and joins; a
    step keeps a written table, and ends when a round changes nothing.
    """
    now = stash(edges.select("a", "b").where("a <> b"), "links")
    size, mark = now.count(), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", "n", F.least("a", "m").alias("m"))
        star = stash(with_key_rows(both, ["a"], least, 2 * size).where("b > a").select(F.col("b").alias("u"), F.col("m").alias("p")).distinct(), "large")
        low = star.groupBy("u").agg(F.min("p").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_key_rows(star, ["u"], low, star.count()).select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m")), F.struct(F.col("p").alias("x"), F.col("m")))).alias("e"))
        now = stash(small.select(F.least("e.x", "e.m").alias("a"), F.greatest("e.x", "e.m").alias("b")).where("a <> b").distinct(), "stars")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        size, mark = seen[0], seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _found(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """doc_id, key, fp, best per row: ``best`` (nobody, doc_id, key) is the
    least id of the row's component, with the least key of it; null ids
    (nobody) come last."""
    each = stash(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = each.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nobody"), "doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("n"))
    roots = components(links(nodes.select("fp"), radius))
    named = stash(roots.join(nodes, roots.node == nodes.fp).select("fp", "root", "first"), "members")
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    linked = with_key_rows(named, ["root"], least, named.count()).select("fp", "least")
    of = stash(nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("best")), "names")
    return with_key_rows(each, ["fp"], of, each.count()).drop("n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row.

    Null and wordless texts have fingerprint zero and link like any other.
    Repeated rows share a fingerprint and so a component. A null doc_id is
    never a component's id; a component of null ids alone has a null id. An
    empty table gives an empty result. Very long texts are read whole; bytes
    of malformed UTF-8 are bytes of words. Other columns are not looked at.
    """
    found = _found(docs, id_col, text_col, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the least id, with all its columns.

    Rows of one id with different texts are kept apart by the texts' hashes;
    null ids are members like others, kept where a component has no other.
    Null and empty texts are copies of one another; an empty table stays empty;
    other columns may have any name. Only what to drop is joined. Rows that
    repeat a kept id and text are reduced to one (those rows alone are shuffled
    for it).
    """
    found = stash(_found(docs, id_col, text_col, RADIUS).select("doc_id", "key", "best"), "components")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    here = lambda t: docs[id_col].eqNullSafe(t["_id"]) & (F.xxhash64(docs[text_col]) == t["_key"])
    names = F.col("doc_id").alias("_id"), F.col("key").alias("_key")
    kept = docs.join(drop := found.where(~same).select(*names).distinct(), here(drop), "left_anti")
    repeated = found.where(same).groupBy(*names).count().where("count > 1").drop("count")
    if repeated.isEmpty():
        return kept
    key = fresh("key", docs)
    once = kept.join(repeated, here(repeated), "left_semi").withColumn(key, F.xxhash64(text_col)).dropDuplicates([id_col, key]).drop(key)
    return kept.join(repeated, here(repeated), "left_anti").unionByName(once)
