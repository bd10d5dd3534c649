"""Lists of 64-bit hashes as Bloom filters of bounded size, for tasks that sort out rows before a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 20, 1 << 28


class Bloom:
    """Two bits for a hash, of which all bits are already random."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def has(self, x: np.ndarray) -> np.ndarray:
        x = x.view(np.uint64)
        ok = np.ones(len(x), bool)
        for shift in (0, 31):
            at = ((x >> np.uint64(shift)) & np.uint64(self.bits - 1)).astype(np.int64)
            ok &= (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return ok


NOTHING, EVERYTHING = Bloom(8, np.zeros(1, np.uint8)), Bloom(8, np.full(1, 255, np.uint8))


def bloom_of(hashes: DataFrame, column: str, n: int) -> Bloom | None:
    """Of the n hashes in a column; None where the list is too long for MAX_BITS."""
    if not n:
        return NOTHING
    if n * 4 > MAX_BITS:
        return None
    bits = MIN_BITS
    while bits < 10 * n and bits < MAX_BITS:
        bits *= 2
    at = F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(bits - 1)) + 1 for s in (0, 31)]))
    spots = hashes.select(at.alias("p"))
    rows = spots.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    table = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(r.m, np.uint8)
        base = (r.b - 1) * 4096
        table[base : base + len(part)] |= part[: len(table) - base]
    return Bloom(bits, table)
