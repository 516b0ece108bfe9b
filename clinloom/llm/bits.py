"""Sets of 64-bit hashes as bitmaps of fixed size: they may hold too much, never too little."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64


def bit_set(hashes: DataFrame, col: str, log2: int) -> np.ndarray:
    """Bitmap of 2**``log2`` bits marking the leading bits of each value of a long column.

    Its size does not depend on the data; when it fills up it lets more pass, so whoever
    asks it must decide exactly afterwards.
    """
    h = F.col(col)
    word = F.shiftrightunsigned(h, 64 - log2 + 6)
    bit = F.shiftrightunsigned(h, 64 - log2).bitwiseAND(F.lit(63)).cast("int")
    rows = hashes.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (log2 - 6), _U)
    for part in rows.toArrow().to_batches():
        out[part.column("word").to_numpy()] = part.column("bits").to_numpy().view(_U)
    return out


def held(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the bitmap may hold the (unsigned) hash."""
    log2 = (len(table) << 6).bit_length() - 1
    at = h >> _U(64 - log2)
    return (table[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
