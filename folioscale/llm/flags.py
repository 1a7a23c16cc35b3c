"""A table of one byte per bucket: which buckets of 64-bit values occur.

Its size is fixed, whatever the input, so it can go to every task. It lets some
other values through, never stops one that occurs; what passes is checked
exactly afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 4096


def bucket_flags(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """``2**bits`` bytes, 1 where the low bits of a value in ``column`` say so."""
    buckets = values.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("bucket")).distinct()

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(PART, np.uint8)
        part[group["bucket"].to_numpy() % PART] = 1
        return pd.DataFrame({"part": [int(group["bucket"].iloc[0]) // PART], "bytes": [part.tobytes()]})

    parts = buckets.groupBy(F.floor(F.col("bucket") / PART).alias("part")).applyInPandas(mark, "part int, bytes binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in parts.collect():  # at most 2**bits / 4096 rows
        out[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(row["bytes"], np.uint8)
    return out
