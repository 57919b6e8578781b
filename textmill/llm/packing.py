"""Best-fit packing after a Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the instance is the histogram of
lengths (at most ``limit`` rows, whatever the corpus). On it the driver first
fixes sets that provably dominate every alternative for their largest piece,
shrinks the histogram and packs the rest by best-fit decreasing. The plan is a
list of runs (length, ranks -> sequences, offset). Ranks within a length are
the rank inside a task plus the pieces of that length in earlier tasks, so no
length is ever sorted or gathered in one place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import prepare, stash
from textmill.llm.encoding import encoder, vocabulary

LIMIT = 4096
END = 1


def reduce_instance(counts: dict[int, int], limit: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets fixed by dominance, each with its number, and what remains.

    For the piece j with room r = limit - j, {j, k} with the largest fitting k
    dominates every set with j if k = r, or if no two pieces fit beside j, or
    if no three do and no two sum to more than k; {j} does if nothing fits.
    If no three fit beside j, {j, k, b} with the largest b that fits beside
    both does if no two pieces larger than b that fit sum to more than k.
    Fewer pieces leave fewer alternatives, so a set is fixed as often as its
    pieces last.
    """
    left, fixed = {w: n for w, n in counts.items() if n > 0}, []
    changed = True
    while changed and left:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j, 0):
                sizes = np.array(sorted(w for w, n in left.items() if n - (w == j) > 0), np.int64)
                room = limit - j
                fit = int(np.searchsorted(sizes, room, "right"))
                if not fit:
                    fixed.append(((j,), left.pop(j)))
                    changed = True
                    break
                k = int(sizes[fit - 1])
                beside = (k,) if k == room else _dominating(sizes, left, j, room, k)
                if beside is None:
                    break
                parts = Counter((j, *beside))
                n = min(left[w] // m for w, m in parts.items())
                fixed.append(((j, *beside), n))
                changed = True
                for w, m in parts.items():
                    left[w] -= n * m
                    if not left[w]:
                        del left[w]
    return fixed, left


def _dominating(sizes: np.ndarray, left: dict[int, int], j: int, room: int, k: int) -> tuple[int, ...] | None:
    """The one or two pieces that with j dominate every set with j, if any do;
    sizes: of the pieces beside j, ascending."""
    few: list[int] = []
    for w in sizes[:3].tolist():
        few += [w] * min(3, left[w] - (w == j))
    few = few[:3]
    if len(few) < 2 or few[0] + few[1] > room:
        return (k,)
    if len(few) == 3 and sum(few) <= room:
        return None
    if k >= _best_pair(sizes, left, j, room):
        return (k,)
    third = next((w for w in reversed(sizes[: np.searchsorted(sizes, room - k, "right")].tolist()) if left[w] - (w == j) - (w == k) > 0), None)
    if third is None or _best_pair(sizes[sizes > third], left, j, room) > k:
        return None
    return (k, third)


def _best_pair(sizes: np.ndarray, left: dict[int, int], j: int, room: int) -> int:
    """The greatest sum of two pieces of these sizes that fits; 0 if none does."""
    partner = np.searchsorted(sizes, room - sizes, "right") - 1
    best = 0
    for a, p in zip(sizes.tolist(), partner.tolist(), strict=True):
        while p >= 0:
            b = int(sizes[p])
            if b != a or left[a] - (a == j) >= 2:
                best = max(best, a + b)
                break
            p -= 1
    return best


def plan(counts: dict[int, int], limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first sequence, offset) in order; sequences."""
    fixed, left = reduce_instance(counts, limit)
    runs: list[tuple[int, int, int, int]] = []
    used: Counter[int] = Counter()
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], sequence, offset))
        used[length] += n

    for pieces, n in fixed:
        at = 0
        for w in pieces:
            put(w, n, sequences, at)
            at += w
        sequences += n
    rooms: list[int] = []  # ascending; open[r]: (first sequence, number) of sequences with room r
    open_: dict[int, list[tuple[int, int]]] = {}

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n))

    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                break
            room = rooms[at]
            first, size = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            take = min(n, size)
            put(w, take, first, limit - room)
            leave(room, first + take, size - take)
            leave(room - w, first, take)
            n -= take
        each = limit // w
        for number, per in ((n // each, each), (1, n % each)):
            if number and per:
                for i in range(per):
                    put(w, number, sequences, i * w)
                leave(limit - per * w, sequences, number)
                sequences += number
    return np.array(sorted(runs), np.int64).reshape(-1, 4), sequences


def pieces(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """One row per piece, with its task and its rank there among its length."""
    prepare(docs.sparkSession)
    path, kind = vocab or vocabulary(), docs.schema[id_col].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, enc = TaskContext.get().partitionId(), Counter(), encoder(path)
        for b in batches:
            row, piece, length, crc, rank = [], [], [], [], []
            for i, ids in enumerate(enc.ids(b.column(1).to_pylist())):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(p)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(seen[n])
                    seen[n] += 1
            p = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(p.astype(np.int32)), pa.array(p * limit), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint")


def pack(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    A null or empty text is the end id alone. Repeated rows are packed each on
    their own. An empty table gives an empty result. Only texts of more than
    ``limit`` ids are cut. Other columns are not looked at.
    """
    each = stash(pieces(docs, limit, id_col, text_col, vocab), "pieces")
    by_task = each.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    runs, _ = plan(counts, limit)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = each.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    shift = 1 << 44  # ranks stay below; (length, rank) is one sorted number
    first = runs[:, 0] * shift + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            at = np.searchsorted(first, length * shift + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(runs[at, 2] + rank - runs[at, 1]), pa.array(runs[at, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
