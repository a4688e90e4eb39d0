"""A fixed-size membership sketch that thins out a scan before an exact join.

The sketch has a set number of bits, whatever it is built from, so it may be broadcast.  A row that it lets through may
still be no member; one that it stops never is.  When it fills up it only stops fewer rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23


class Sketch:
    """2**bits flags by hash; broadcast to the tasks."""

    def __init__(self, flags: Broadcast, bits: int, probes: int = 1):
        self.flags, self.bits, self.probes = flags, bits, probes

    def lets_through(self, hashes: np.ndarray) -> np.ndarray:
        """Flags for uint64 hashes, by their highest bits; with two probes, by their lowest bits, too."""
        packed = np.frombuffer(self.flags.value, np.uint8)
        flag = lambda at: (packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
        found = flag(hashes >> np.uint64(64 - self.bits))
        if self.probes > 1:
            some = np.flatnonzero(found)
            found[some] = flag(hashes[some] & np.uint64((1 << self.bits) - 1))
        return found


def sketch(hashes: DataFrame, col: str, bits: int = BITS, probes: int = 1) -> Sketch:
    """The sketch of a long column of hashes (nulls take no part); 2**bits / 8 bytes reach the driver in all."""
    at = F.shiftrightunsigned(F.col(col), 64 - bits)
    given = hashes.where(F.col(col).isNotNull())
    if probes > 1:
        given, at = given.select(F.explode(F.array(at, F.col(col).bitwiseAND(F.lit((1 << bits) - 1)))).alias("at")), F.col("at")
    rows = (
        given.groupBy(F.bitmap_bucket_number(at).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("flags"))
        .collect()
    )
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows:
        # bucket 0 holds the number 0 only; bucket b holds (b - 1) * 32768 + 1 .. b * 32768, counted from 0
        flags = np.unpackbits(np.frombuffer(row["flags"], np.uint8), bitorder="little")
        numbers = np.flatnonzero(flags) + ((row["bucket"] - 1) * 32768 + 1 if row["bucket"] > 0 else 0)
        np.bitwise_or.at(packed, numbers >> 3, (1 << (numbers & 7)).astype(np.uint8))
    context = hashes.sparkSession.sparkContext
    return Sketch(context.broadcast(packed.tobytes()), bits, probes)


def thin(df: DataFrame, key: Column, members: Sketch) -> DataFrame:
    """Rows of df whose key (a long hash column) the sketch lets through."""

    @F.arrow_udf("boolean")
    def passes(keys):
        import pyarrow as pa

        return pa.array(members.lets_through(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    return df.where(passes(key))
