"""Sets of hashes as bits of a fixed number: built by Spark, broadcast, and
asked by array operations. Such a set may hold more than was put in, never
less, so it is for holding back rows that an exact step would drop anyway."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of one row that the JVM aggregates to bits (4 KB).
_BLOCK = 1 << 15


def cell_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each unsigned 64-bit hash: its leading bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def broadcast_cells(cells: DataFrame, size: int) -> Broadcast:
    """The set of the values of column ``cell``, all in [0, size), as size/8
    bytes. The bits are put together by block in Spark; what reaches the
    driver is at most those bytes, however many rows there are."""
    own = F.col("cell")
    blocks = cells.groupBy(F.floor(own / _BLOCK).cast("long").alias("block")).agg(F.bitmap_construct_agg(own % _BLOCK).alias("bits")).toArrow()
    out = np.zeros(max(1, -(-size // _BLOCK)) * _BLOCK // 8, np.uint8)
    for block, bits in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist(), strict=True):
        out[block * _BLOCK // 8 :][: len(bits)] = np.frombuffer(bits, np.uint8)
    return cells.sparkSession.sparkContext.broadcast(out)


def held(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
