"""A bitmap of ids with a fixed size, to read only wanted rows of a large table before a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap; its size does not depend on the data (1 MiB).
BITS = 1 << 23


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Which hashes of the ids occur. Words of 64 bits are combined on the executors; at most BITS / 64 of them
    reach the driver. A fuller bitmap lets more rows through, never fewer than the wanted ones."""
    place = ids.select(F.pmod(F.pmod(F.col(column), F.lit(BITS)) * F.lit(2654435761), F.lit(BITS)).alias("place"))
    words = place.groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def wanted(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = (ids * np.int64(2654435761)) % BITS
    return ((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
