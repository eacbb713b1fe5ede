"""A Bloom filter over 64-bit keys, built by Spark and tested in tasks with numpy.

It only thins what a later exact step decides, so a full filter costs time and
nothing else.  Its size follows the number of keys up to a fixed largest one,
which bounds what is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 16, 29  # log2 of the bits: 8 KB to 64 MB
PER_KEY = 16


@dataclass(frozen=True)
class Bloom:
    words: np.ndarray  # uint64
    bits: int          # log2

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return (keys & mask).astype(np.int64), ((keys >> np.uint64(64 - self.bits)) & mask).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key (uint64) may be among those put in."""
        out = np.ones(len(keys), bool)
        for slot in self._slots(keys):
            out &= (self.words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out

    def has(self, key: int) -> bool:
        """:meth:`holds` of one key."""
        for slot in (key & ((1 << self.bits) - 1), key >> (64 - self.bits)):
            if not int(self.words[slot >> 6]) >> (slot & 63) & 1:
                return False
        return True


def build(keys: DataFrame, count: int) -> Bloom:
    """The filter of the one long column of ``keys``, of which there are about ``count``; bits are joined on Spark's side."""
    bits = min(MOST, max(LEAST, int(count * PER_KEY).bit_length()))
    key = F.col(keys.columns[0])
    slot = F.explode(F.array(key.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(key, 64 - bits)))
    # a long of 2^(bits - 6) at most comes to the driver, whatever the number of keys
    rows = (keys.select(slot.alias("slot"))
            .groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63L as int))")).alias("bits"))).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return Bloom(words.view(np.uint64), bits)
