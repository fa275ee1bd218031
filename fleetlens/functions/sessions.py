"""Session measures (P6) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.gpu import int_div


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total_tokens(prompt, completion) -> Column:
    return (_c(prompt) + _c(completion)).cast("long")


def tokens_per_second(completion, eval_ns) -> Column:
    """completion * 1e9 / eval_ns, 0.0 when eval_ns is 0."""
    c, e = _c(completion), _c(eval_ns)
    return F.when(e > 0, c.cast("double") * F.lit(1e9) / e.cast("double")).otherwise(F.lit(0.0))


def time_to_first_token_ms(start, first_token) -> Column:
    """Whole milliseconds from start to first token (truncated); null without a token."""
    s, f = _c(start), _c(first_token)
    return int_div(F.unix_micros(f) - F.unix_micros(s), 1000)


def time_per_output_token_ms(completion, eval_ns) -> Column:
    """eval_ns / 1e6 / completion, null unless both are above 0."""
    c, e = _c(completion), _c(eval_ns)
    return F.when((c > 0) & (e > 0), e.cast("double") / F.lit(1e6) / c.cast("double"))


def duration_seconds(start, end) -> Column:
    """(end - start) in seconds as a double (microsecond precision); null without an end."""
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))).cast("double") / F.lit(1e6)
