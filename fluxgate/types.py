"""The CDF type registry: storage, constants, compatibility and inference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CdfType:
    code: int
    name: str
    size: int
    dtype: str  # numpy, without byte order; "" for none
    spark: str
    pad: Any = None
    fill: Any = None


# Fixed values of the format: codes, sizes, and default pad and fill values.
TYPES = {
    t.name: t
    for t in (
        CdfType(0, "CDF_NONE", 0, "", "void"),
        CdfType(1, "CDF_INT1", 1, "i1", "tinyint", -127, -128),
        CdfType(2, "CDF_INT2", 2, "i2", "smallint", -32767, -32768),
        CdfType(4, "CDF_INT4", 4, "i4", "int", -2147483647, -2147483648),
        CdfType(8, "CDF_INT8", 8, "i8", "bigint", -9223372036854775807, -9223372036854775808),
        CdfType(11, "CDF_UINT1", 1, "u1", "smallint", 254, 255),
        CdfType(12, "CDF_UINT2", 2, "u2", "int", 65534, 65535),
        CdfType(14, "CDF_UINT4", 4, "u4", "bigint", 4294967294, 4294967295),
        CdfType(21, "CDF_REAL4", 4, "f4", "float", -1e30, -1e31),
        CdfType(22, "CDF_REAL8", 8, "f8", "double", -1e30, -1e31),
        CdfType(31, "CDF_EPOCH", 8, "f8", "double", 0.0, -1e31),
        CdfType(32, "CDF_EPOCH16", 16, "f8", "struct<seconds:double,picoseconds:double>", (0.0, 0.0), (-1e31, -1e31)),
        CdfType(33, "CDF_TIME_TT2000", 8, "i8", "bigint", -9223372036854775807, -9223372036854775808),
        CdfType(41, "CDF_BYTE", 1, "i1", "tinyint", -127, -128),
        CdfType(44, "CDF_FLOAT", 4, "f4", "float", -1e30, -1e31),
        CdfType(45, "CDF_DOUBLE", 8, "f8", "double", -1e30, -1e31),
        CdfType(51, "CDF_CHAR", 1, "S1", "string", "\0", None),
        CdfType(52, "CDF_UCHAR", 1, "S1", "string", "\0", None),
    )
}
BY_CODE = {t.code: t for t in TYPES.values()}
TIME_TYPES = ("CDF_EPOCH", "CDF_EPOCH16", "CDF_TIME_TT2000")
CHAR_TYPES = ("CDF_CHAR", "CDF_UCHAR")

# Which source types a destination takes without force.
_COMPATIBLE = {
    "CDF_NONE": tuple(TYPES),
    **dict.fromkeys(CHAR_TYPES, CHAR_TYPES),
    **dict.fromkeys(TIME_TYPES, TIME_TYPES),
    **dict.fromkeys(("CDF_DOUBLE", "CDF_REAL8"), ("CDF_DOUBLE", "CDF_REAL8", "CDF_FLOAT", "CDF_INT1", "CDF_INT2", "CDF_INT4", "CDF_UINT1", "CDF_UINT2", "CDF_UINT4")),
    **dict.fromkeys(("CDF_FLOAT", "CDF_REAL4"), ("CDF_FLOAT", "CDF_REAL4", "CDF_INT1", "CDF_INT2", "CDF_UINT1", "CDF_UINT2")),
    "CDF_INT8": ("CDF_INT8", "CDF_INT4", "CDF_INT2", "CDF_INT1", "CDF_UINT4", "CDF_UINT2", "CDF_UINT1"),
    "CDF_INT4": ("CDF_INT4", "CDF_INT2", "CDF_INT1", "CDF_UINT2", "CDF_UINT1"),
    "CDF_INT2": ("CDF_INT2", "CDF_INT1", "CDF_UINT1"),
    "CDF_INT1": ("CDF_INT1",),
    "CDF_BYTE": ("CDF_INT1",),
    "CDF_UINT4": ("CDF_UINT4", "CDF_UINT2", "CDF_UINT1"),
    "CDF_UINT2": ("CDF_UINT2", "CDF_UINT1"),
    "CDF_UINT1": ("CDF_UINT1",),
}


def compatible(dest: str, source: str) -> bool:
    """Whether values of ``source`` may be set on a variable of type ``dest``."""
    return source in _COMPATIBLE.get(dest, ())


def compatible_column(dest: Column, source: Column) -> Column:
    """``compatible`` for columns of type names."""
    out = F.lit(False)
    for d, sources in _COMPATIBLE.items():
        out = F.when(dest == d, source.isin(*sources)).otherwise(out)
    return out


def shapes_compatible(current: Sequence[int], new: Sequence[int], is_nrv: bool) -> bool:
    """Whether values of shape ``new`` (records first) may replace ``current``.
    Record-varying: same rank and record shape.  Non-record-varying: the record
    dimension may be left out, and must be 0 or 1 if given."""
    if not current:
        return True
    if not is_nrv:
        return len(current) == len(new) and tuple(current[1:]) == tuple(new[1:])
    if len(new) == len(current):
        return new[0] <= 1 and tuple(current[1:]) == tuple(new[1:])
    return tuple(current[1:]) == tuple(new)


def default_pad_value(name: str) -> Any:
    return TYPES[name].pad


def default_fill_value(name: str) -> Any:
    return TYPES[name].fill


def smallest_int_type(low: int, high: int) -> str:
    """The smallest type for integers from ``low`` to ``high``: signed only below
    zero; above 32 bits always eight bytes."""
    if low < 0:
        for name, bits in (("CDF_INT1", 7), ("CDF_INT2", 15), ("CDF_INT4", 31)):
            if -(1 << bits) <= low and high < 1 << bits:
                return name
        return "CDF_INT8"
    for name, bits in (("CDF_UINT1", 8), ("CDF_UINT2", 16), ("CDF_UINT4", 32)):
        if high < 1 << bits:
            return name
    return "CDF_INT8"


def smallest_int_type_column(low: Column, high: Column) -> Column:
    """``smallest_int_type`` for columns of bounds."""
    signed = F.lit("CDF_INT8")
    for name, bits in (("CDF_INT4", 31), ("CDF_INT2", 15), ("CDF_INT1", 7)):
        signed = F.when((low >= F.lit(-(1 << bits))) & (high < F.lit(1 << bits)), name).otherwise(signed)
    plain = F.lit("CDF_INT8")
    for name, bits in (("CDF_UINT4", 32), ("CDF_UINT2", 16), ("CDF_UINT1", 8)):
        plain = F.when(high < F.lit(1 << bits), name).otherwise(plain)
    return F.when(low < 0, signed).otherwise(plain)


def _flatten(value: Any) -> tuple[tuple[int, ...], list]:
    """(shape, flat leaves) of nested lists; ragged or mixed nesting raises."""
    if not isinstance(value, (list, tuple)):
        return (), [value]
    parts = [_flatten(v) for v in value]
    if len({p[0] for p in parts}) > 1:
        raise IndexError("ragged values, or values beside lists")
    return (len(value), *(parts[0][0] if parts else ())), [x for p in parts for x in p[1]]


def infer(value: Any) -> tuple[str, tuple[int, ...], np.ndarray]:
    """(type name, shape with the string length last, flat array) for Python lists or
    numpy arrays.  Strings become UCHAR padded to the longest UTF-8 length, datetimes
    TT2000, any float DOUBLE, integers the smallest type; other values raise."""
    if isinstance(value, np.ndarray):
        return _infer_numpy(value)
    shape, leaves = _flatten(value)
    if not leaves:
        return "CDF_NONE", (), np.zeros(0)
    kinds = {"s" if isinstance(x, (str, bytes)) else "t" if isinstance(x, (datetime, np.datetime64)) else "f" if isinstance(x, (float, np.floating)) else "i" if isinstance(x, (int, np.integer)) and not isinstance(x, bool) else "?" for x in leaves}
    if kinds == {"s"}:
        raw = [x if isinstance(x, bytes) else x.encode() for x in leaves]
        width = max(map(len, raw))
        return "CDF_UCHAR", (*shape, width), np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), "u1")
    if kinds == {"t"}:
        from .functions.time import tt2000_of_ns

        ns = [int(np.datetime64(x.replace(tzinfo=None) if isinstance(x, datetime) else x, "ns").astype("i8")) for x in leaves]
        return "CDF_TIME_TT2000", shape, np.array([tt2000_of_ns(x) for x in ns], "i8")
    if kinds <= {"f", "i"} and "f" in kinds:
        return "CDF_DOUBLE", shape, np.array(leaves, "f8")
    if kinds == {"i"}:
        name = smallest_int_type(min(leaves), max(leaves))
        return name, shape, np.array(leaves, TYPES[name].dtype)
    raise ValueError("values of these kinds can't be stored together")


def _infer_numpy(value: np.ndarray) -> tuple[str, tuple[int, ...], np.ndarray]:
    kind, size = value.dtype.kind, value.dtype.itemsize
    if kind in "SU":
        return infer(np.char.encode(value, "utf-8").tolist() if kind == "U" else value.tolist())
    if kind == "M":
        from .functions.time import tt2000_of_ns

        flat = value.astype("datetime64[ns]").astype("i8").ravel()
        return "CDF_TIME_TT2000", value.shape, np.array([tt2000_of_ns(int(x)) for x in flat], "i8")
    names = {("i", 1): "CDF_INT1", ("i", 2): "CDF_INT2", ("i", 4): "CDF_INT4", ("i", 8): "CDF_INT8", ("u", 1): "CDF_UINT1", ("u", 2): "CDF_UINT2", ("u", 4): "CDF_UINT4", ("u", 8): "CDF_INT8", ("f", 4): "CDF_FLOAT", ("f", 8): "CDF_DOUBLE"}
    if (kind, size) not in names:
        raise ValueError(f"no CDF type for {value.dtype}")
    name = names[kind, size]
    return name, value.shape, np.ascontiguousarray(value).ravel().view(TYPES[name].dtype) if size == 8 else np.ascontiguousarray(value).ravel()
