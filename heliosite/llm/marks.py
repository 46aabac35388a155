"""A bitmap of fixed size that tells scans which hashes matter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Marks:
    """A bitmap of at most 2**27 bits (16 MB) over hashes. It lets some others through, which later exact steps drop."""

    BITS = 27
    PARTS = 10

    @classmethod
    def of(cls, hashes: DataFrame) -> np.ndarray:
        """From a column ``h``; each of 2**PARTS pieces is made by a task, and their fixed size bounds what the driver gets."""
        inner = cls.BITS - cls.PARTS
        bits = f"shiftrightunsigned(h, {64 - cls.BITS})"
        words = hashes.selectExpr(f"cast(shiftright({bits}, 5) as int) as word", f"shiftleft(1L, cast({bits} & 31 as int)) as bits").groupBy("word").agg(F.bit_or("bits").alias("bits"))

        def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
            part = np.zeros(1 << (inner - 5), np.uint32)
            part[group["word"].to_numpy() & ((1 << (inner - 5)) - 1)] = group["bits"].to_numpy().astype(np.uint32)
            return pd.DataFrame({"part": [int(keys[0])], "bits": [part.tobytes()]})

        made = words.groupBy(F.shiftright("word", inner - 5).alias("part")).applyInPandas(run, "part int, bits binary").collect()
        out = np.zeros((1 << cls.PARTS, 1 << (inner - 5)), np.uint32)
        for row in made:
            out[row["part"]] = np.frombuffer(row["bits"], np.uint32)
        return out.ravel()

    @classmethod
    def has(cls, marks: np.ndarray, h: np.ndarray) -> np.ndarray:
        bit = h >> np.uint64(64 - cls.BITS)
        return (marks[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
