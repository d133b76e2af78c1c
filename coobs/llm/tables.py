"""Small helpers of the operators: written intermediate tables and bounded filters."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.session import cut_lineage

__all__ = ["cut_lineage", "digest", "filter_bits", "release_memory", "spare", "BITS"]

BITS = 1 << 26


def digest(text: Column | str) -> Column:
    """Identity of a text: equal texts, and only those, agree.  Null stays null."""
    return F.unhex(F.sha2(F.col(text) if isinstance(text, str) else text, 256))


def spare(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores added until no given column is called so (whatever its case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def release_memory() -> None:
    """Give what a worker has freed back to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def filter_bits(keys: DataFrame, key: str, bits: int = BITS) -> np.ndarray:
    """A bit set over hashed long keys, of a fixed size whatever the number of keys.

    A full set only lets more rows through; the join that follows is exact.
    """
    slot = F.pmod(F.col(key), F.lit(bits))
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask")
    )
    table = words.toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[table["word"].to_numpy(np.int64)] = table["mask"].to_numpy(np.int64)
    return out.view(np.uint64)
