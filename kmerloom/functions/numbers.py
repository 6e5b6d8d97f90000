"""Numbers as they are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(x: Column) -> Column:
    """Signed to unsigned, small ones first: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.call_function("shiftleft", x, F.lit(1)).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))
