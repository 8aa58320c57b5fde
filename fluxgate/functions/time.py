"""Time encodings as Column expressions: TT2000, EPOCH, EPOCH16 and UTC nanoseconds.

Canonical time is a BIGINT of nanoseconds since 1970 (``ns``).  Fill values are
not handled by conversions, only by ``time_repr``; conversions that leave the
range of a BIGINT give null."""

from __future__ import annotations

from bisect import bisect_right
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
EPOCH_MS = 62_167_219_200_000.0
EPOCH_S = 62_167_219_200.0
TT2000_NS = 946_727_967_816_000_000
_MOST = (1 << 63) - 1
# The days on which TAI - UTC grew by a second, from 10 s on the first.
LEAP_DAYS = (
    "1972-01-01 1972-07-01 1973-01-01 1974-01-01 1975-01-01 1976-01-01 1977-01-01 1978-01-01 1979-01-01 1980-01-01 "
    "1981-07-01 1982-07-01 1983-07-01 1985-07-01 1988-01-01 1990-01-01 1991-01-01 1992-07-01 1993-07-01 1994-07-01 "
    "1996-01-01 1997-07-01 1999-01-01 2006-01-01 2009-01-01 2012-07-01 2015-07-01 2017-01-01"
).split()
#: (first ns since 1970, offset in ns)
LEAPS = [((date.fromisoformat(d) - date(1970, 1, 1)).days * 86400 * SECOND, (10 + i) * SECOND) for i, d in enumerate(LEAP_DAYS)]
#: The same by TT2000.
TT2000_LEAPS = [(b - TT2000_NS + o, o) for b, o in LEAPS]


def big(x: int) -> Column:
    return F.lit(x).cast("bigint")


def int_div(a: Column, b: int) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", a, big(b))


def floor_div(a: Column, b: int) -> Column:
    """Integer quotient, floored."""
    return int_div(a, b) - F.when(F.pmod(a, big(b)) != a % big(b), big(1)).otherwise(big(0))


def _lookup(x: Column, table: list[tuple[int, int]]) -> Column:
    """Offset of the last row at or before x, newest first: recent times match at once."""
    out = F.when(x >= big(table[-1][0]), big(table[-1][1]))
    for first, offset in reversed(table[:-1]):
        out = out.when(x >= big(first), big(offset))
    return F.when(x.isNotNull(), out.otherwise(big(0)))


def leap_second(ns: Column) -> Column:
    return _lookup(ns, LEAPS)


def leap_second_tt2000(tt: Column) -> Column:
    return _lookup(tt, TT2000_LEAPS)


def tt2000_to_ns(tt: Column) -> Column:
    # one comparison keeps overflow out; checked additions would cost more per row
    most = _MOST - TT2000_NS + TT2000_LEAPS[-1][1]
    return F.when(tt <= big(most), tt - leap_second_tt2000(tt) + big(TT2000_NS))


def ns_to_tt2000(ns: Column) -> Column:
    return F.when(ns >= big(TT2000_NS - _MOST - 1), ns - big(TT2000_NS) + leap_second(ns))


def epoch_to_ns(ms: Column) -> Column:
    """In doubles, as for whole arrays: sub-microsecond digits may be rounded."""
    return ((ms - F.lit(EPOCH_MS)) * F.lit(1e6)).try_cast("bigint")


def epoch_to_ns_exact(ms: Column) -> Column:
    """Whole milliseconds exactly, and the fraction truncated."""
    d = ms - F.lit(EPOCH_MS)
    whole = d.try_cast("bigint")
    return F.try_add(F.try_multiply(whole, big(1_000_000)), ((d - whole.cast("double")) * F.lit(1e6)).try_cast("bigint"))


def epoch16_to_ns(e: Column) -> Column:
    """In doubles, as for whole arrays."""
    return ((e["seconds"] - F.lit(EPOCH_S)) * F.lit(1e9) + e["picoseconds"] / F.lit(1e3)).try_cast("bigint")


def epoch16_to_ns_exact(e: Column) -> Column:
    s = (e["seconds"] - F.lit(EPOCH_S)).try_cast("bigint")
    return F.try_add(F.try_multiply(s, big(SECOND)), (e["picoseconds"] / F.lit(1e3)).try_cast("bigint"))


def ns_to_epoch(ns: Column) -> Column:
    return int_div(ns, 1_000_000).cast("double") + F.lit(EPOCH_MS)


def ns_to_epoch16(ns: Column) -> Column:
    s = int_div(ns, SECOND)
    return F.struct((s.cast("double") + F.lit(EPOCH_S)).alias("seconds"), ((ns - s * big(SECOND)).cast("double") * F.lit(1e3)).alias("picoseconds"))


_TO_NS = {"CDF_EPOCH": epoch_to_ns, "CDF_EPOCH16": epoch16_to_ns, "CDF_TIME_TT2000": tt2000_to_ns}
_FROM_NS = {"CDF_EPOCH": ns_to_epoch, "CDF_EPOCH16": ns_to_epoch16, "CDF_TIME_TT2000": ns_to_tt2000}


def to_ns(x: Column, cdf_type: str) -> Column:
    if cdf_type not in _TO_NS:
        raise ValueError(f"{cdf_type} is not a time type")
    return _TO_NS[cdf_type](x)


def from_ns(ns: Column, cdf_type: str) -> Column:
    if cdf_type not in _FROM_NS:
        raise ValueError(f"{cdf_type} is not a time type")
    return _FROM_NS[cdf_type](ns)


def convert(x: Column, source: str, dest: str) -> Column:
    """From one CDF time encoding to another."""
    return x if source == dest else from_ns(to_ns(x, source), dest)


def timestamp_to_ns(ts: Column) -> Column:
    """From TIMESTAMP, or TIMESTAMP_NTZ read as UTC (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * big(1000)


def ns_to_timestamp(ns: Column) -> Column:
    """To TIMESTAMP: floored to microseconds."""
    return F.timestamp_micros(floor_div(ns, 1000))


def unix_seconds_to_ns(s: Column) -> Column:
    """Double seconds since 1970, rounded to milliseconds."""
    return F.floor(s * F.lit(1e3) + F.lit(0.5)).cast("bigint") * big(1_000_000)


def to_time_string(ns: Column, fmt: str = "%Y-%m-%dT%H:%M:%SZ") -> Column:
    """Format with %Y %m %d %j %H %M %S %%; %S has nine digits of fraction.  Built
    from the date and integer arithmetic, so the session's time zone has no part."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ns, 86400 * SECOND).cast("int"))
    rest = F.pmod(ns, big(86400 * SECOND))
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    parts = {
        "Y": digits(F.year(day), 4),
        "m": digits(F.month(day), 2),
        "d": digits(F.dayofmonth(day), 2),
        "j": digits(F.dayofyear(day), 3),
        "H": digits(int_div(rest, 3600 * SECOND), 2),
        "M": digits(int_div(rest, 60 * SECOND) % 60, 2),
        "S": F.concat(digits(int_div(rest, SECOND) % 60, 2), F.lit("."), digits(rest % big(SECOND), 9)),
        "%": F.lit("%"),
    }
    out, text, i = [], "", 0
    while i < len(fmt):
        if fmt[i] != "%":
            text, i = text + fmt[i], i + 1
            continue
        code = fmt[i + 1 : i + 2]
        if code not in parts:
            raise ValueError(f"unsupported specifier %{code}")
        out += [F.lit(text)] * bool(text) + [parts[code]]
        text, i = "", i + 2
    out += [F.lit(text)] * bool(text)
    return F.concat(*out) if out else F.lit("")


def iso(ns: Column) -> Column:
    return to_time_string(ns, "%Y-%m-%dT%H:%M:%SZ")


def time_repr(x: Column, cdf_type: str) -> Column:
    """Text of a CDF time; fill and pad values have texts of their own."""
    plain = lambda ns: to_time_string(ns, "%Y-%m-%dT%H:%M:%S")
    if cdf_type == "CDF_EPOCH":
        return F.when(x == F.lit(-1e31), "9999-12-31T23:59:59.999").when(x == F.lit(0.0), "0000-01-01T00:00:00.000").otherwise(plain(epoch_to_ns_exact(x)))
    if cdf_type == "CDF_EPOCH16":
        both = lambda v: (x["seconds"] == F.lit(v)) & (x["picoseconds"] == F.lit(v))
        return F.when(both(-1e31), "9999-12-31T23:59:59.999999999").when(both(0.0), "0000-01-01T00:00:00.000000000000").otherwise(plain(epoch16_to_ns_exact(x)))
    if cdf_type == "CDF_TIME_TT2000":
        least = -(1 << 63)
        last = "9999-12-31T23:59:59.999999999"
        return F.when(x == big(least), last).when(x == big(least + 1), "0000-01-01T00:00:00.000000000").when(x == big(least + 3), last).otherwise(plain(tt2000_to_ns(x)))
    raise ValueError(f"{cdf_type} is not a time type")


def leap_of_ns(ns: int) -> int:
    at = bisect_right([b for b, _ in LEAPS], ns)
    return LEAPS[at - 1][1] if at else 0


def tt2000_of_ns(ns: int) -> int:
    """For single Python values, as in literals and inferred lists."""
    return ns - TT2000_NS + leap_of_ns(ns)


def ns_of_tt2000(tt: int) -> int:
    at = bisect_right([b for b, _ in TT2000_LEAPS], tt)
    return tt - (TT2000_LEAPS[at - 1][1] if at else 0) + TT2000_NS
