"""Joins that stand hot keys, and that leave most texts where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most.
HOT = 10_000
#: Bits of the bitmap of wanted keys at most: 64 MB, broadcast in parts of 4 KB.
BITS, PART = 1 << 29, 1 << 15


def join_by_key(rows: DataFrame, found: DataFrame, keys: list[str], total: int, how: str = "inner", n: str = "n", hot: int = HOT) -> DataFrame:
    """rows joined (inner or left) with found, which has each key once and, as n, the rows of that key.

    A key with more than total / hot of the rows is hot. There are fewer than hot of these,
    whatever the input, so they are broadcast and their rows stay where they are; all other
    rows are shuffled by key, in groups of at most total / hot.
    """
    heavy = F.col(n) > total / hot
    few = F.broadcast(found.where(heavy).drop(n))
    near = rows.join(few, keys)
    far = rows.join(few.select(*keys), keys, "left_anti").join(found.where(~heavy).drop(n), keys, how)
    return near.unionByName(far)


def with_likely(df: DataFrame, wanted: DataFrame, keys: list[str], flag: str, bits: int = BITS) -> DataFrame:
    """df with a flag that is true for every row whose keys are in wanted, and for few others; false where a key is null.

    The flag is a bit of the keys' hash in a broadcast bitmap of 16 bits for each wanted
    row, at most 64 MB. It spares the rows that are not wanted a shuffle; an exact join must
    follow. Beyond some hundred million wanted keys the flag is true ever more often, and the
    join behind it sees ever more rows.
    """
    n = wanted.count()
    size = max(PART, min(bits, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(size))
    part, bit = (place / PART).cast("int"), F.pmod(place, F.lit(PART)).cast("int")
    bitmap = wanted.select(part.alias("__part"), bit.cast("long").alias("__bit")).groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    rows = df.withColumn("__part", part).withColumn("__bit", bit).join(F.broadcast(bitmap), "__part", "left")
    byte = F.conv(F.hex(F.substring("__map", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.expr(" and ".join(f"`{k}` is not null" for k in keys)) & (F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, __bit % 8)")), F.lit(0)) > 0)
    return rows.withColumn(flag, found).drop("__part", "__bit", "__map")
