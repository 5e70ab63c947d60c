"""SimHash fingerprints and their positional bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashes whose bits are counted at once.
CHUNK = 1 << 17


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit ``hashes``, as a signed integer."""
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[a : a + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def positional_byte(fp: Column | str, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("long"))


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of the positional bytes that two fingerprints share."""
    differ = a.bitwiseXOR(b)
    return sum(F.when(positional_byte(differ, i) == 0, 1).otherwise(0) for i in range(8))
