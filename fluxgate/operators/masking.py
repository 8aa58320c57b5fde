"""Validity masks, and decisions from metadata made before any values are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import record_length, total_elements
from ..types import CHAR_TYPES

MAX_LINES = 8
MAX_RANK = 2
MAX_PLOT = 10_000_000
MAX_PREVIEW = 2_000_000


def quality_mask(x: Column, fill: Column | float | None = None, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """x, or null where it is not finite, equals the fill value, or lies outside the
    valid range.  A bound that is None, or null in its row, is open."""
    x = x.cast("double")
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    for bound, test in ((fill, lambda b: x == b), (low, lambda b: x < b), (high, lambda b: x > b)):
        if bound is not None:
            bad = bad | F.coalesce(test(bound if isinstance(bound, Column) else F.lit(float(bound))), F.lit(False))
    return F.when(~bad, x)


def plot_refusal(shape: Column, type_name: Column) -> Column:
    """Why a variable is not drawn, by its metadata alone; null if it is."""
    rank = F.size(shape)
    return (
        F.when(type_name.isin(*CHAR_TYPES), "character data is not plottable")
        .when((rank <= 0) | shape.isNull() | (F.get(shape, F.lit(0)) == 0), "no records to plot")
        .when(rank > MAX_RANK, F.concat(rank.cast("string"), F.lit("-dimensional data is not plottable")))
        .when(total_elements(shape) > MAX_PLOT, "too large to plot")
    )


def previewable(shape: Column) -> Column:
    return total_elements(shape) <= MAX_PREVIEW


def display_kind(shape: Column, display_type: Column, override: str | None = None) -> Column:
    """line or spectrogram: the override, else DISPLAY_TYPE, else by record length."""
    if override in ("line", "spectrogram"):
        return F.lit(override)
    d = F.lower(F.trim(display_type))
    by_length = F.when(record_length(shape) <= MAX_LINES, "line").otherwise("spectrogram")
    return F.when(d == "time_series", "line").when(d == "spectrogram", "spectrogram").otherwise(by_length)
