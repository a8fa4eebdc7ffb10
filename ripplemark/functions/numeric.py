"""Numeric column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.checks import finite_number

# Fixed value: rate constant of the Parzen bandwidth rule, from k''(0) = -12 and
# k^{0,0} = 0.269 (Barndorff-Nielsen, Hansen, Lunde & Shephard, 2009).
PARZEN_BANDWIDTH_CONSTANT = (144 / 0.269) ** 0.2

#: One basis point is 1e-4 of the price.
BASIS_POINTS = 1e4


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite(value: Column | str) -> Column:
    """True for ordinary numbers; false for null, NaN and infinities. Never null."""
    c = as_column(value).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def is_positive(value: Column | str) -> Column:
    """True for finite numbers above zero (NaN is *not*, although ``NaN > 0`` is in Spark)."""
    c = as_column(value)
    return is_finite(c) & (c > 0)


def annualized_volatility_pct(variance: Column | str, periods_per_year: Column | float) -> Column:
    """Variance per period as annual volatility in percent: 100 sqrt(N variance)."""
    if isinstance(periods_per_year, Column):
        periods = periods_per_year
    else:
        if finite_number(periods_per_year, "periods_per_year") <= 0:
            raise ValueError("periods_per_year must be positive")
        periods = F.lit(float(periods_per_year))
    return F.lit(100.0) * F.sqrt(periods * as_column(variance))


def parzen_weight(x: Column | float) -> Column | float:
    """The Parzen kernel, for a column or for a plain number known when the plan is built."""
    if isinstance(x, Column):
        a = F.abs(x)
        near = F.lit(1.0) - 6.0 * a * a * (F.lit(1.0) - a)
        far = 2.0 * F.pow(F.lit(1.0) - a, F.lit(3.0))
        return F.when(a <= 0.5, near).when(a <= 1.0, far).otherwise(F.lit(0.0))
    a = abs(x)
    if a > 1.0:
        return 0.0
    return 1.0 - 6.0 * a * a * (1.0 - a) if a <= 0.5 else 2.0 * (1.0 - a) ** 3


def parzen_bandwidth(noise_to_signal: Column | str, n_returns: Column | str) -> Column:
    """Kernel bandwidth ceil(c xi^(4/5) n^(3/5)), where xi^2 is the noise-to-signal ratio.

    Null where the ratio is not a positive number or there is no return.
    """
    ratio, n = as_column(noise_to_signal), as_column(n_returns)
    size = F.lit(PARZEN_BANDWIDTH_CONSTANT) * F.pow(F.sqrt(ratio), F.lit(0.8)) * F.pow(n, F.lit(0.6))
    return F.when(is_positive(ratio) & (n >= 1), F.ceil(size).cast("bigint"))


def spread_bps(bid: Column | str, ask: Column | str, mid: Column | str) -> Column:
    """Quoted spread in basis points of the mid price; null where that is zero."""
    return F.try_divide(as_column(ask) - as_column(bid), as_column(mid)) * F.lit(BASIS_POINTS)


# W. J. Cody's rational approximations of erf/erfc ("Rational Chebyshev
# approximations for the error function", Math. Comp. 1969), highest power first.
_ERF_SMALL_TOP = ("1.85777706184603153e-1", "3.16112374387056560e0", "1.13864154151050156e2",
                  "3.77485237685302021e2", "3.20937758913846947e3")
_ERF_SMALL_BOTTOM = ("1e0", "2.36012909523441209e1", "2.44024637934444173e2",
                     "1.28261652607737228e3", "2.84423683343917062e3")
_ERFC_MIDDLE_TOP = ("2.15311535474403846e-8", "5.64188496988670089e-1", "8.88314979438837594e0",
                    "6.61191906371416295e1", "2.98635138197400131e2", "8.81952221241769090e2",
                    "1.71204761263407058e3", "2.05107837782607147e3", "1.23033935479799725e3")
_ERFC_MIDDLE_BOTTOM = ("1e0", "1.57449261107098347e1", "1.17693950891312499e2",
                       "5.37181101862009858e2", "1.62138957456669019e3", "3.29079923573345963e3",
                       "4.36261909014324716e3", "3.43936767414372164e3", "1.23033935480374942e3")
_ERFC_TAIL_TOP = ("1.63153871373020978e-2", "3.05326634961232344e-1", "3.60344899949804439e-1",
                  "1.25781726111229246e-1", "1.60837851487422766e-2", "6.58749161529837803e-4")
_ERFC_TAIL_BOTTOM = ("1e0", "2.56852019228982242e0", "1.87295284992346725e0",
                     "5.27905102951428412e-1", "6.05183413124413191e-2", "2.33520497626869185e-3")


def _polynomial(coefficients: tuple[str, ...], x: str) -> str:
    text = coefficients[0]
    for coefficient in coefficients[1:]:
        text = f"({text} * {x} + {coefficient})"
    return text


def normal_sf_sql(z: str, scaled: str | None = None, square: str | None = None, inverse: str | None = None) -> str:
    """SQL text of the standard normal survival function 1 - Phi(z) of the column ``z``.

    Plain arithmetic, so it stays inside code generation and runs in any SQL engine. The other
    arguments name columns that already hold |z| / sqrt(2), its square and 1 / square.
    """
    y = scaled or f"(abs({z}) * 7.0710678118654752e-1)"
    square = square or f"({y} * {y})"
    inverse = inverse or f"(1e0 / {square})"
    small = (
        f"5e-1 - 5e-1 * {z} * 7.0710678118654752e-1 * {_polynomial(_ERF_SMALL_TOP, square)}"
        f" / {_polynomial(_ERF_SMALL_BOTTOM, square)}"
    )
    middle = (
        f"5e-1 * exp(-{square}) * {_polynomial(_ERFC_MIDDLE_TOP, y)}"
        f" / {_polynomial(_ERFC_MIDDLE_BOTTOM, y)}"
    )
    tail = (
        f"5e-1 * exp(-{square}) / {y} * (5.6418958354775628695e-1 - {inverse}"
        f" * {_polynomial(_ERFC_TAIL_TOP, inverse)} / {_polynomial(_ERFC_TAIL_BOTTOM, inverse)})"
    )
    upper = (
        f"(CASE WHEN {y} <= 4e0 THEN {middle} WHEN {y} < 2.7e1 THEN {tail} ELSE 0e0 END)"
    )
    return (
        f"(CASE WHEN {z} IS NULL THEN NULL WHEN {y} <= 4.6875e-1 THEN {small}"
        f" WHEN {z} > 0e0 THEN {upper} ELSE 1e0 - {upper} END)"
    )


def with_normal_sf(frame: DataFrame, z: str, name: str) -> DataFrame:
    """Add 1 - Phi of the column named ``z``; what the formula repeats is computed once."""
    y = F.abs(z) * F.lit(math.sqrt(0.5))
    square = F.col("_y") * F.col("_y")
    inverse = F.lit(1.0) / F.nullif(F.col("_y2"), F.lit(0.0))
    return (
        frame.withColumn("_y", y)
        .withColumn("_y2", square)
        .withColumn("_y3", inverse)
        .withColumn(name, F.expr(normal_sf_sql(f"`{z}`", "_y", "_y2", "_y3")))
        .drop("_y", "_y2", "_y3")
    )
