"""Level scaling and colours as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The anchors of the colour map.
VIRIDIS = ((68, 1, 84), (72, 40, 120), (62, 74, 137), (49, 104, 142), (38, 130, 142), (31, 158, 137), (53, 183, 121), (110, 206, 88), (181, 222, 43), (253, 231, 37))


def normalize_level(v: Column, low: Column, high: Column, log: bool = False) -> Column:
    """A value's place in [low, high], 0 to 1; null for null, for a log scale with a
    value or bound that is not positive, and for an empty range."""
    if log:
        ok = (v > 0) & (low > 0) & (high > 0) & (low != high)
        return F.when(ok, (F.log10(v) - F.log10(low)) / (F.log10(high) - F.log10(low)))
    return F.when(low != high, (v - low) / (high - low))


def viridis(t: Column) -> Column:
    """struct(r, g, b) of a level, clamped to [0, 1], linear between the anchors."""
    last = len(VIRIDIS) - 1
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * F.lit(float(last))
    i = F.floor(x).cast("int")

    def channel(c: int) -> Column:
        anchors = F.array(*[F.lit(float(a[c])) for a in VIRIDIS])
        a, b = F.get(anchors, i), F.get(anchors, F.least(i + 1, F.lit(last)))
        return F.floor(a + (b - a) * (x - i) + F.lit(0.5)).cast("int")

    return F.when(t.isNotNull(), F.struct(*[channel(c).alias(n) for c, n in enumerate("rgb")]))
