"""Sets of candidate ids: a Bloom filter of bits built from one table, pushed below the scoring, and the exact set after it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at most (1 MB as a literal); larger sets have more false positives, never wrong results.
MOST_BITS = 1 << 23
BITS_AN_ID = 10
HASHES = 4
#: Bits of one bitmap, as Spark's bitmap functions lay them out.
_BITMAP = 32768


def _places(id_: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(id_, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


class IdFilter:
    """Bits of a set of ids: `may_hold` is true for every id of the set, and false for most others."""

    def __init__(self, ids: DataFrame, id_col: str = "id"):
        n = ids.count()
        self.bits = min(MOST_BITS, max(_BITMAP, 1 << math.ceil(math.log2(max(1, n * BITS_AN_ID)))))
        at = ids.where(F.col(id_col).isNotNull()).select(F.explode(F.array(*_places(F.col(id_col), self.bits))).alias("p"))
        maps = at.groupBy(F.floor(F.col("p") / _BITMAP).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(_BITMAP))).alias("bits"))
        held = {r.b: bytes(r["bits"]) for r in maps.collect()}  # MOST_BITS at most
        self.raw = b"".join(held.get(i, bytes(_BITMAP // 8)) for i in range(self.bits // _BITMAP))

    def may_hold(self, id_: Column) -> Column:
        def bit(p: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.lit(self.raw), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1

        out = F.lit(True)
        for p in _places(id_, self.bits):
            out = out & bit(p)
        return F.coalesce(out & id_.isNotNull(), F.lit(False))


def among(points: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """points whose id is in `ids` (one column of that name): the filter first, on each point by itself, then the exact set, which only what passed meets."""
    passed = points.where(IdFilter(ids, id_col).may_hold(F.col(id_col)))
    return passed.join(ids.select(id_col).distinct(), id_col, "left_semi").select(points.columns)
