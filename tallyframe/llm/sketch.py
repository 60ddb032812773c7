"""A count sketch of fixed size over all rows: each task counts hashes by slot, parts are added as a tree, levels come back."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 22
_PARTS = 64
#: Parts of the sketch that one group adds up.
_FAN = 256
_U = np.uint64


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def packed(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """One task's counts (32 bits a slot) as columns ``part, counts``."""
    return pa.array(range(_PARTS), pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in counts.reshape(_PARTS, -1)], pa.binary())


def _sum(blocks) -> np.ndarray:
    total = np.zeros(SLOTS // _PARTS, _U)
    for x in blocks:
        total += np.frombuffer(pa.decompress(x, decompressed_size=4 * len(total), codec="zstd", asbytes=True), np.uint32)
    return total


def _partly(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of some tasks' counts of one part."""
    total = np.minimum(_sum(pdf["counts"]), 2**32 - 1).astype(np.uint32)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [pa.compress(total.tobytes(), "zstd", asbytes=True)]})


def level_of(count):
    """Four steps for each doubling."""
    return np.minimum(np.log2(np.asarray(count) + 1.0) * 4, 255).astype(np.uint8)


def _last(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "level": [level_of(_sum(pdf["counts"])).tobytes()]})


def levels(parts: DataFrame) -> np.ndarray:
    """Levels of all slots from ``(part int, counts binary)`` of all tasks; no group holds the parts of more than some hundred tasks."""
    tasks = parts.filter("part = 0").count()
    while tasks > _FAN:
        tasks = -(-tasks // _FAN)
        parts = parts.groupBy("part", F.pmod(F.xxhash64("counts"), F.lit(tasks))).applyInPandas(_partly, "part int, counts binary")
    out = np.zeros((_PARTS, SLOTS // _PARTS), np.uint8)
    for r in parts.groupBy("part").applyInPandas(_last, "part int, level binary").collect():  # one byte for each slot
        out[r["part"]] = np.frombuffer(r["level"], np.uint8)
    return out.ravel()
