"""Noise as columns: a hash of a key and a counter, so a value depends on neither partitions nor order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13  # hexadecimal ones of a hash: 52 bits, the fraction of a double


def uniform(counter: int, *key: Column) -> Column:
    """A number in (0, 1) of the key and a counter: the middle of one of 2^52 steps."""
    digest = F.md5(F.concat_ws(":", F.lit(str(counter)), *[k.cast("string") for k in key]).cast("binary"))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(2.0 ** (4 * DIGITS))


def normal(counter: int, *key: Column) -> Column:
    """A standard normal number from the uniform ones of this counter and the next."""
    return F.sqrt(-2 * F.log(uniform(counter, *key))) * F.cos(2 * math.pi * uniform(counter + 1, *key))
