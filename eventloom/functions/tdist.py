"""Two-sided p-value of Student's t as a column expression (Spark has no t distribution).

P(|T| >= |t|) is the regularised incomplete beta function at df / (df + t^2) with the
parameters df / 2 and 1/2, here by the continued fraction of Abramowitz & Stegun
26.5.8, taken from its last term backwards in one fold over the term numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' approximation of the gamma function for g = 7.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
_HALF_LOG_TWO_PI = 0.9189385332046727
#: Pairs of terms: so many, and so many times the root of the larger parameter.
TERMS, TERMS_BY_ROOT = 60, 5


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z >= 1/2."""
    series = F.lit(LANCZOS[0])
    for i, factor in enumerate(LANCZOS[1:]):
        series = series + F.lit(factor) / (z + i)
    base = z + (LANCZOS_G - 0.5)
    return F.lit(_HALF_LOG_TWO_PI) + (z - 0.5) * F.ln(base) - base + F.ln(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    pairs = (F.lit(TERMS) + TERMS_BY_ROOT * F.sqrt(F.greatest(a, b))).cast("int")

    def step(tail: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return 1.0 + even / (1.0 + odd / tail)

    folded = F.aggregate(F.sequence(pairs, F.lit(1)), F.lit(1.0), step)
    return 1.0 / (1.0 - (a + b) * x / (a + 1) / folded)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b) for a, b >= 1/2; null where an argument is."""
    swap = x > (a + 1.0) / (a + b + 2.0)

    def part(v: Column) -> Column:
        front = F.exp(
            log_gamma(v["a"] + v["b"]) - log_gamma(v["a"]) - log_gamma(v["b"]) + v["a"] * F.ln(v["x"]) + v["b"] * F.ln(1.0 - v["x"])
        )
        return front * _fraction(v["a"], v["b"], v["x"]) / v["a"]

    # A one-element array names the arguments for the lambda, so that each is evaluated once.
    given = F.struct(
        F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), F.when(swap, 1.0 - x).otherwise(x).alias("x")
    )
    value = F.get(F.transform(F.array(given), part), F.lit(0))
    inside = F.when(swap, 1.0 - value).otherwise(value)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) with ``dof`` degrees of freedom, 1 or more.

    Null where either is null or not a number, or where ``dof`` is below 1; an infinite t
    has p = 0.
    """
    t, dof = t.cast("double"), dof.cast("double")
    known = t.isNotNull() & ~F.isnan(t) & ~F.isnan(dof) & (dof >= 1)
    x = dof / (dof + t * t)
    return F.when(known, F.when(F.abs(t) == float("inf"), 0.0).otherwise(incomplete_beta(dof / 2, F.lit(0.5), x)))
