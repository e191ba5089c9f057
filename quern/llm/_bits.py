"""A bit set for 64-bit hashes, built by rows and sent to all tasks.

Its size follows the number of hashes up to ``2**MOST`` bits (64 MB). It never misses a hash that was put in. Beyond that
size it fills up and lets more of the others through; whatever uses it must be exact without it.
"""

from __future__ import annotations

import numpy as np
from numpy.typing import NDArray
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import released

LEAST, MOST = 20, 29
U64 = NDArray[np.uint64]


def bit_set(keys: DataFrame) -> U64:
    """The set of one long column, of about 16 bits for each row; rows are counted first, so they had better be a table."""
    key = keys.columns[0]
    bits = min(MOST, max(LEAST, int(16 * keys.count()).bit_length()))
    at = F.array(F.shiftrightunsigned(key, 64 - bits), F.shiftrightunsigned(key, 60 - 2 * bits).bitwiseAND((1 << bits) - 1))
    words = keys.select(F.explode(at).alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word"))
    with released(keys.sparkSession):
        got = words.agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def holds(words: U64, keys: U64) -> NDArray[np.bool_]:
    """Which keys may be in the set; the others are not."""
    bits = len(words).bit_length() + 5
    a, b = keys >> np.uint64(64 - bits), keys >> np.uint64(60 - 2 * bits) & np.uint64((1 << bits) - 1)
    bit = lambda x: words[x >> np.uint64(6)] >> (x & np.uint64(63))
    return (bit(a) & bit(b) & np.uint64(1)).astype(bool)
