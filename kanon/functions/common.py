"""Small Column builders shared by every module (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_null(c: str | Column) -> Column:
    """``nullif(trim(coalesce(c, '')), '')`` — empty, blank and NULL are one value."""
    return F.nullif(F.trim(F.coalesce(col(c), F.lit(""))), F.lit(""))


def present(c: str | Column) -> Column:
    """True when the text is neither NULL nor blank (never NULL itself)."""
    return blank_null(c).isNotNull()


def percent(part: str | Column, total: str | Column) -> Column:
    """``round_half_even(100 * part / total, 2)``; 0 when total <= 0. Exact decimal maths, double out."""
    p = col(part).cast("decimal(20,0)")
    t = col(total).cast("decimal(20,0)")
    return (
        F.when(col(total) <= 0, F.lit(0.0))
        .otherwise(F.bround(p * F.lit(100) / t, 2).cast("double"))
    )


def micros_ntz(c: str | Column) -> Column:
    """Microseconds since epoch of a TIMESTAMP_NTZ (time-zone independent)."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), col(c).cast("timestamp_ntz"))


def clamp(value: int | None, default: int, lo: int, hi: int) -> int:
    v = default if value is None or value <= 0 else value
    return max(lo, min(hi, v))


def ntz_to_instant(c: str | Column) -> Column:
    """TIMESTAMP_NTZ wall clock read as UTC → TIMESTAMP (session-time-zone independent)."""
    return F.timestamp_micros(micros_ntz(c))


def instant_to_ntz(c: str | Column) -> Column:
    """TIMESTAMP → its UTC wall clock as TIMESTAMP_NTZ (session-time-zone independent)."""
    secs = (F.unix_micros(col(c)).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr(EPOCH_NTZ) + F.make_dt_interval(secs=secs)
