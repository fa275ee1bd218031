"""Output formatting: RFC 3339 times (P9), session display rows (P8), argument checks (P10).

Numbers round the exact binary value of the double to the nearest decimal (an
exact tie goes up, away from zero), as a browser prints them; no grouping.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed format: RFC 3339 with six fraction digits and a numeric UTC offset (+00:00).
RFC3339_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def rfc3339(ts) -> Column:
    """A timestamp as RFC 3339 text in UTC (session zone must be UTC)."""
    return F.date_format(_c(ts), RFC3339_PATTERN)


def clock_time(ts) -> Column:
    """``HH:mm:ss`` of a timestamp (UTC)."""
    return F.date_format(_c(ts), "HH:mm:ss")


def fixed(value, digits: int) -> Column:
    """``value`` with ``digits`` (at most 9) decimals, rounded on its exact binary value; from 1e21 on in
    exponent form, and NaN, Infinity as such, as a browser prints them.

    The fraction, scaled by 2^62, is an exact BIGINT, so the comparison with one half is exact
    integer arithmetic; a formatter would round the shortest decimal form instead.
    """
    x = _c(value).cast("double")
    printed = F.abs(x) < F.lit(1e21)                     # false for NaN too: Spark puts it above all numbers
    size = F.when(printed, F.abs(x)).otherwise(F.lit(0.0))
    word = F.lit(float(1 << 32))                         # a double's upper and lower words are exact BIGINTs
    high = F.floor(size / word)
    low = size - high.cast("double") * word
    whole = high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.floor(low).cast("decimal(20,0)")
    one = F.lit(1 << 62).cast("decimal(20,0)")
    scaled = ((low - F.floor(low)) * F.lit(float(1 << 62))).cast("long").cast("decimal(20,0)") * F.lit(10 ** digits).cast("decimal(10,0)")
    down = F.floor(scaled / one).cast("decimal(20,0)")
    rest = scaled - down * one
    steps = whole.cast("decimal(22,0)") * F.lit(10 ** digits).cast("decimal(10,0)") + down + F.when(rest * 2 >= one, 1).otherwise(0)
    text = F.lpad(steps.cast("decimal(32,0)").cast("string"), 32, "0")
    body = F.regexp_replace(F.substring(text, 1, 32 - digits), "^0+(?=[0-9])", "")
    if digits:
        body = F.concat(body, F.lit("."), F.substring(text, 33 - digits, digits))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    large = F.regexp_replace(F.regexp_replace(F.abs(x).cast("string"), r"\.0(?=E)", ""), "E", "e+")
    return (F.when(printed, F.concat(sign, body)).when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), F.lit("NaN"))
            .otherwise(F.concat(sign, F.when(F.abs(x) == F.lit(float("inf")), F.lit("Infinity")).otherwise(large))))


def ttft_text(ttft_ms) -> Column:
    """``"{n}ms"``, or ``-`` when null or 0."""
    t = _c(ttft_ms)
    return F.when(t.isNull() | (t == 0), F.lit("-")).otherwise(F.concat(t.cast("string"), F.lit("ms")))


def duration_text(seconds) -> Column:
    """``-`` when null or 0; under a minute ``"{s, 0 dp}s"``; else ``"{min, 1 dp}m"``."""
    d = _c(seconds)
    return (F.when(d.isNull() | (d == 0), F.lit("-"))
            .when(d < 60, F.concat(fixed(d, 0), F.lit("s")))
            .otherwise(F.concat(fixed(d / 60.0, 1), F.lit("m"))))


def model_base_name(model) -> Column:
    """Text before the first ``:``."""
    return F.substring_index(_c(model), ":", 1)


def thousands_text(n) -> Column:
    """Token totals as ``"{n / 1000, 1 dp}k"``."""
    return F.concat(fixed(_c(n).cast("double") / 1000.0, 1), F.lit("k"))


# P10: argument validation, before any plan is built.
_RFC3339_RE = re.compile(
    r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")


def parse_rfc3339(value: str, argument: str) -> _dt.datetime:
    """Parse an RFC 3339 argument to an aware UTC datetime; ``ValueError`` naming it otherwise."""
    if not isinstance(value, str) or not _RFC3339_RE.match(value):
        raise ValueError(f"Invalid {argument} format: {value!r} is not RFC 3339")
    text = value.replace("t", "T").replace(" ", "T")
    text = text[:-1] + "+00:00" if text[-1] in "Zz" else text
    frac = re.search(r"\.(\d+)", text)
    if frac and len(frac.group(1)) > 6:  # Python keeps microseconds; drop finer digits
        text = text.replace(frac.group(0), "." + frac.group(1)[:6])
    try:
        parsed = _dt.datetime.fromisoformat(text)
    except ValueError as exc:
        raise ValueError(f"Invalid {argument} format: {value!r}") from exc
    return parsed.astimezone(_dt.timezone.utc)


def as_instant(value, argument: str = "time") -> _dt.datetime:
    """Accept an aware datetime, a naive datetime (taken as UTC) or RFC 3339 text."""
    if isinstance(value, _dt.datetime):
        return value if value.tzinfo else value.replace(tzinfo=_dt.timezone.utc)
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day, tzinfo=_dt.timezone.utc)
    return parse_rfc3339(value, argument)


def ts_literal(value, argument: str = "time") -> Column:
    """A TIMESTAMP literal of an instant (validated); independent of the session zone."""
    inst = as_instant(value, argument).astimezone(_dt.timezone.utc)
    return F.lit(inst.isoformat()).cast("timestamp")


_RFC3339_PARTS = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:[Zz]|[+-](\d{2}):(\d{2}))\z"


def is_rfc3339(text) -> Column:
    """Whether a text column holds an RFC 3339 time; false for null."""
    t = _c(text)
    part = lambda n: F.regexp_extract(t, _RFC3339_PARTS, n)
    below = lambda n, most: F.coalesce(part(n).try_cast("int"), F.lit(0)) < most
    return F.coalesce((part(1) != "") & part(1).try_cast("date").isNotNull() & below(2, 24) & below(3, 60) & below(4, 60)
                      & below(5, 24) & below(6, 60), F.lit(False))


def range_error(start, end) -> Column:
    """P10 on data: the error of a (start, end) text range, naming the first argument that is not RFC 3339; null if both are."""
    return (F.when(~is_rfc3339(start), F.lit("Invalid start format")).when(~is_rfc3339(end), F.lit("Invalid end format"))
            .otherwise(F.lit(None).cast("string")))
