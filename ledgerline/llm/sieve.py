"""A set of hashes as a bitmap of fixed size, to keep rows without a partner out of a shuffle.

The bitmap has ``2**bits`` bits however large the data: 16 MB at 27. A hash that is in the set always
passes, another one with the chance that its bit is taken. A full bitmap lets every row pass; results
stay the same, only the shuffle grows, so ``bits`` is to be chosen by the memory of a worker.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27
_PAGE_BITS = 15  # bitmap_construct_agg gives 4096 bytes for each bucket


def bitmaps(
    df: DataFrame, key: Column, conditions: list[str], bits: int = BITS, fetched: int | None = None
) -> list[np.ndarray]:
    """For each condition the bitmap over the top ``bits`` of a long hash in the rows that meet it; one pass for all.

    The driver fetches it by a job for each shuffle partition, or in ``fetched`` parts."""
    place = F.shiftrightunsigned(key, 64 - bits) + F.lit(1)
    built = [F.expr(f"bitmap_construct_agg(__bit) filter (where {c})").alias(f"__{i}") for i, c in enumerate(conditions)]
    pages = (
        df.withColumns({"__page": F.bitmap_bucket_number(place), "__bit": F.bitmap_bit_position(place)})
        .groupBy("__page")
        .agg(*built)
    )
    if fetched:
        pages = pages.repartition(fetched)
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in conditions]
    size = 1 << (_PAGE_BITS - 3)
    for row in pages.toLocalIterator():
        at = (row["__page"] - 1) * size
        for i, one in enumerate(out):
            one[at : at + size] = np.frombuffer(bytes(row[f"__{i}"]), np.uint8)
    return out


def bitmap(df: DataFrame, key: Column, bits: int = BITS, fetched: int | None = None) -> np.ndarray:
    """The bitmap over the top ``bits`` of a long hash."""
    return bitmaps(df, key, ["true"], bits, fetched)[0]


def coarser(bits: np.ndarray) -> np.ndarray:
    """The same set in an eighth of the memory: eight neighbouring places become one."""
    return np.packbits(bits != 0, bitorder="little")


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be in the set."""
    width = int(bits.size * 8).bit_length() - 1
    place = hashes >> np.uint64(64 - width)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
