"""Column helpers shared by every metric.

Everything here returns a built-in ``Column`` expression, so it stays inside
whole-stage codegen; nothing is evaluated in Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
MICROS_PER_DAY = 86_400_000_000


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso(c: str | Column) -> Column:
    """Render an instant as text at the sink (UTC session zone)."""
    return F.date_format(col_(c), ISO_FORMAT)


def as_double(c: str | Column) -> Column:
    return col_(c).cast("double")


def round2(c: str | Column, digits: int = 2) -> Column:
    """NULL-safe rounding to ``digits`` places, as a DOUBLE."""
    return F.round(as_double(c), digits)


_ZERO = object()


def pct(num: str | Column, den: str | Column, when_zero: Column | None | object = _ZERO) -> Column:
    """``num / den * 100`` rounded to 2 dp; ``when_zero`` (default 0.0) if the denominator is 0/NULL."""
    d = as_double(den)
    ratio = F.round(as_double(num) / d * F.lit(100.0), 2)
    if when_zero is _ZERO:
        fallback = F.lit(0.0)
    else:
        fallback = when_zero if when_zero is not None else F.lit(None).cast("double")
    return F.when(d.isNull() | (d == 0), fallback).otherwise(ratio)


def count_if(cond: Column) -> Column:
    """``COUNT(CASE WHEN cond THEN 1 END)`` — NULL conditions do not count."""
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column, value: str | Column) -> Column:
    """``COALESCE(SUM(CASE WHEN cond THEN value ELSE 0 END), 0)``."""
    v = col_(value)
    return F.coalesce(F.sum(F.when(cond, v).otherwise(F.lit(0))), F.lit(0))


def has_ac(ac: str | Column) -> Column:
    """Generated column: acceptance criteria present and not blank."""
    a = col_(ac)
    return F.coalesce(F.trim(a) != F.lit(""), F.lit(False))


def cycle_days(start: str | Column, end: str | Column) -> Column:
    """Exact fractional days between two instants, rounded to 2 dp."""
    micros = F.unix_micros(col_(end)) - F.unix_micros(col_(start))
    days = micros.cast("decimal(20,0)") / F.lit(MICROS_PER_DAY).cast("decimal(20,0)")
    return F.round(days, 2).cast("double")


def latest_n(
    df: DataFrame,
    n: int | None,
    order: list[Column],
    partition: str = "project_id",
    rank_col: str = "rank",
) -> DataFrame:
    """Keep the first ``n`` rows per ``partition`` under ``order``.

    This is the set-based form of the reference's per-project
    ``ORDER BY … LIMIT n``; Spark plans the ``rank <= n`` filter as a
    ``WindowGroupLimit`` so each task keeps only its top ``n`` before the
    window shuffle. ``n=None`` keeps every row but still numbers them.
    """
    w = Window.partitionBy(partition).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    if n is not None:
        # Filter on the raw row_number so the planner can infer WindowGroupLimit.
        ranked = ranked.filter(F.col(rank_col) <= F.lit(int(n)))
    return ranked.withColumn(rank_col, F.col(rank_col).cast("long"))


def rag(c: str | Column, green: float = 80.0, amber: float = 60.0, null_band: str | None = "grey") -> Column:
    """Red/amber/green band of a percentage; ``null_band`` for NULL input."""
    v = as_double(c)
    band = F.when(v >= green, "green").when(v >= amber, "amber").otherwise("red")
    if null_band is None:
        return band
    return F.when(v.isNull(), F.lit(null_band)).otherwise(band)


def fmt_number(c: str | Column, suffix: str = "", decimals: int = 1) -> Column:
    """``Number(v).toFixed(d) + suffix``, em dash for NULL."""
    v = as_double(c)
    # format_number adds thousands separators; format_string does not.
    text = F.format_string(f"%.{decimals}f", v)
    return F.when(v.isNull(), F.lit("—")).otherwise(F.concat(text, F.lit(suffix)))
