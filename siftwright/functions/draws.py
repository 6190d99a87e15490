"""Counter-based random draws: a hash of seed, row key and draw number, whatever the partitioning.

The first 15 hexadecimal digits of an MD5 digest are an integer that SQL engines reproduce exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 60


def draw(seed: int, *parts: Column | str | int) -> Column:
    """An integer in [0, 2^60)."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def unit(seed: int, *parts: Column | str | int) -> Column:
    """A number in [0, 1)."""
    return draw(seed, *parts) / F.lit(float(SPAN))


def pick(n: int | Column, seed: int, *parts: Column | str | int) -> Column:
    """An integer in [0, n)."""
    return F.pmod(draw(seed, *parts), n.cast("long") if isinstance(n, Column) else F.lit(n).cast("long"))
