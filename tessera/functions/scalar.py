"""Scalar functions with PostgreSQL behaviour where Spark's own differs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white-space character that trim() of the dialect removes.
SPACES = " \t\n\r\x0b\x0c"


def asc(c: Column | str) -> Column:
    """Ascending, NULLs last (the dialect's default)."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    """Descending, NULLs first (the dialect's default)."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero; division by zero is an error under ANSI mode."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def concat_skip_nulls(*cols: Column) -> Column:
    return F.concat_ws("", *(c.cast("string") for c in cols))


def concat_op(*cols: Column) -> Column:
    """The || operator: implicit conversion to text, NULL if any part is NULL."""
    return F.concat(*(c.cast("string") for c in cols))


def substr(s: Column, start: int, length: int | None = None) -> Column:
    """1-based; start 0 counts as 1; a negative start gives an empty string."""
    if start < 0:
        return F.when(s.isNotNull(), F.lit(""))
    return F.substring(s, max(start, 1), 2**31 - 1 if length is None else length)


def strpos(s: Column, needle: str) -> Column:
    return F.instr(s, needle).cast("bigint")


def split_part(s: Column, delimiter: str, n: int) -> Column:
    """1-based; part 0 counts as the first; out of range gives an empty string."""
    return F.split_part(s, F.lit(delimiter), F.lit(n or 1))


def trim_all(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACES))


def ltrim_all(s: Column) -> Column:
    return F.ltrim(s, F.lit(SPACES))


def rtrim_all(s: Column) -> Column:
    return F.rtrim(s, F.lit(SPACES))


def sqrt_strict(x: Column) -> Column:
    """Square root; negative input is an error."""
    return F.when(x < 0, F.raise_error(F.lit("square root of a negative number"))).otherwise(F.sqrt(x))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounding on binary doubles as floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * scale + F.lit(0.5)) / scale


def dow(ts: Column) -> Column:
    """Day of week, Sunday = 0."""
    return (F.dayofweek(ts) - 1).cast("bigint")


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp")).cast("bigint")


def truncate(field: str, ts: Column) -> Column:
    return F.date_trunc(field, ts).cast("timestamp_ntz")


def vector_of(text: Column) -> Column:
    """'[1.0, 2]' as array<float>; malformed text or non-finite numbers are an error, NULL stays NULL."""
    parsed = F.from_json(text, "array<float>", {"mode": "PERMISSIVE"})
    bad = text.isNotNull() & (parsed.isNull() | F.exists(parsed, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid vector: "), text))).otherwise(parsed)
