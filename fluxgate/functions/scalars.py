"""Time conversions of Python values and numpy arrays, for the driver side.

Columns use ``functions.time``; these give the same results for what is in memory."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import Any, NamedTuple

import numpy as np

from .time import EPOCH_MS, EPOCH_S, LEAPS, SECOND, TT2000_LEAPS, TT2000_NS


class TT2000(NamedTuple):
    nseconds: int


class Epoch(NamedTuple):
    mseconds: float


class Epoch16(NamedTuple):
    seconds: float
    picoseconds: float


def _offsets(x: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    at = np.searchsorted(np.array([b for b, _ in table]), x, side="right")
    return np.r_[0, [o for _, o in table]].astype("i8")[at]


def to_ns(values: Any, cdf_type: str) -> np.ndarray:
    """CDF times to nanoseconds since 1970, as bulk conversion computes them; EPOCH16
    has a last dimension of two.  What doesn't fit 64 bits is NaT's number."""
    a = np.asarray(values)
    if cdf_type == "CDF_TIME_TT2000":
        a = a.astype("i8")
        with np.errstate(over="ignore"):
            return a - _offsets(a, TT2000_LEAPS) + TT2000_NS
    if cdf_type == "CDF_EPOCH":
        x = (a.astype("f8") - EPOCH_MS) * 1e6
    elif cdf_type == "CDF_EPOCH16":
        x = (a[..., 0].astype("f8") - EPOCH_S) * 1e9 + a[..., 1].astype("f8") / 1e3
    else:
        raise ValueError(f"{cdf_type} is not a time type")
    return np.where(np.abs(x) < 9.2e18, x, np.float64(-(2.0**63))).astype("i8")


def to_datetime64(values: Any, cdf_type: str) -> np.ndarray:
    return to_ns(values, cdf_type).view("datetime64[ns]")


def to_datetime(values: Any, cdf_type: str) -> list:
    """datetimes of the same nesting, floored to microseconds."""
    zero = datetime(1970, 1, 1)
    ns = to_ns(values, cdf_type)
    return np.vectorize(lambda x: zero + timedelta(microseconds=int(x) // 1000), otypes=[object])(ns).tolist()


def ns_of(values: Any) -> np.ndarray:
    """datetimes, datetime64 of any unit, the classes above, or lists of all these, to
    nanoseconds since 1970."""
    for kind, name in ((TT2000, "CDF_TIME_TT2000"), (Epoch, "CDF_EPOCH"), (Epoch16, "CDF_EPOCH16")):
        if isinstance(values, kind):
            return to_ns(values if kind is Epoch16 else values[0], name)[()]
    if isinstance(values, np.ndarray) and values.dtype.kind == "M":
        return values.astype("datetime64[ns]").astype("i8")
    if isinstance(values, (list, tuple)):
        return np.array([ns_of(v) for v in values], "i8")
    if isinstance(values, datetime) and values.tzinfo:
        values = values.astimezone(timezone.utc).replace(tzinfo=None)
    return np.datetime64(values, "ns").astype("i8")


def to_tt2000(values: Any, cdf_type: str | None = None) -> np.ndarray:
    """From datetimes, or from another CDF time type."""
    ns = to_ns(values, cdf_type) if cdf_type else ns_of(values)
    return ns - TT2000_NS + _offsets(ns, LEAPS)


def to_epoch(values: Any, cdf_type: str | None = None) -> np.ndarray:
    ns = to_ns(values, cdf_type) if cdf_type else ns_of(values)
    return np.trunc(ns / 1_000_000) + EPOCH_MS if np.abs(ns).max(initial=0) < 1 << 53 else (np.sign(ns) * (np.abs(ns) // 1_000_000)) + EPOCH_MS


def to_epoch16(values: Any, cdf_type: str | None = None) -> np.ndarray:
    ns = to_ns(values, cdf_type) if cdf_type else ns_of(values)
    s = np.sign(ns) * (np.abs(ns) // SECOND)
    return np.stack([s + EPOCH_S, (ns - s * SECOND) * 1e3], axis=-1)
