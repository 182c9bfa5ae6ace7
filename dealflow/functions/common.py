"""Small Column helpers shared by the finance and text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def lit_inf() -> Column:
    return F.lit(INF).cast("double")


def lit_nan() -> Column:
    return F.lit(float("nan")).cast("double")


def is_finite(c: Column) -> Column:
    """True for a real number: not NaN, not +/-inf (null stays null)."""
    return ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def div_or_inf(num: Column, den: Column) -> Column:
    """``num / den`` when ``den > 0`` else +inf (the reference's ratio convention).

    Written with ``when`` so the ANSI divide-by-zero check never fires.
    """
    return F.when(den > 0, num / den).otherwise(lit_inf())


def safe_div(num: Column, den: Column) -> Column:
    """``num / den``, null where ``den == 0`` (the reference raises there).

    ``nullif`` keeps the ANSI divide-by-zero check from firing without
    repeating ``num`` in the expression tree.
    """
    return num / F.nullif(den, F.lit(0.0))


def clamp(c: Column, lo, hi) -> Column:
    """``max(lo, min(hi, c))`` exactly as Python evaluates it.

    Python's ``min(hi, nan)`` is ``hi``; Spark orders NaN above every number,
    so ``least(hi, nan)`` is ``hi`` as well, and the two agree on every input.
    """
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.greatest(lo_c, F.least(hi_c, c))


def floor_zero(c: Column) -> Column:
    """``max(c, 0.0)`` as Python evaluates it (NaN stays NaN in both)."""
    return F.greatest(c, F.lit(0.0))


def round_to(c: Column, decimals: int, max_sig: int = 9) -> Column:
    """Half-up rounding to ``decimals`` places, at most ``max_sig`` significant digits.

    Computed as ``floor(x * 10^d + 0.5) / 10^d`` in binary floating point
    (``10^d`` is exact), which is the same IEEE operation sequence in Spark and
    DuckDB -- unlike ``round``, which rounds the shortest decimal string.  Large
    magnitudes (e.g. a diverged Newton IRR) keep ``max_sig`` digits so that
    last-ulp ``pow`` differences between engines do not show.  The result
    stays a double throughout (no integer cast that could saturate);
    infinities and NaN pass through.
    """
    a = F.abs(c)
    big = a >= F.lit(10.0 ** (max_sig - decimals))
    # digits before the point minus one
    e = F.floor(F.log10(F.when(big, a).otherwise(F.lit(1.0)))).cast("int")
    d_big = F.lit(max_sig - 1) - e
    up = F.pow(F.lit(10.0), F.greatest(d_big, F.lit(0)).cast("double"))
    down = F.pow(F.lit(10.0), F.greatest(-d_big, F.lit(0)).cast("double"))
    big_val = F.when(d_big >= 0, F.floor(c * up + F.lit(0.5)).cast("double") / up).otherwise(
        F.floor(c / down + F.lit(0.5)).cast("double") * down)
    scale = F.lit(float(10 ** decimals))
    small_val = F.floor(c * scale + F.lit(0.5)).cast("double") / scale
    return F.when(~is_finite(c), c).when(big, big_val).otherwise(small_val)


def round_money(c: Column) -> Column:
    """Two decimals at any size; a double of 2^53 cents or more has none to round."""
    cents = F.floor(c * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)
    return F.when(F.abs(c) < F.lit(2.0 ** 53 / 100), cents).otherwise(c)


def round_ratio(c: Column) -> Column:
    return round_to(c, 6)
