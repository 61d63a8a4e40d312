"""Tails of the normal and the chi-square distribution (one degree of freedom) as column expressions.

The complementary error function follows Cody's rational approximations (Mathematics of
Computation 23, 1969), to about 15 digits; its logarithm stays finite far into the tail.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import _ratio

# Fixed values of the published algorithm: numerator and denominator coefficients by rising power,
# of x^2 (centre, up to 0.46875), x (middle, up to 4) and 1 / x^2 (far).
CENTRE = (
    (3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2, 3.16112374387056560e0, 1.85777706184603153e-1),
    (2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2, 2.36012909523441209e1, 1.0),
)
MIDDLE = (
    (1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3, 8.81952221241769090e2, 2.98635138197400131e2, 6.61191906371416295e1, 8.88314979438837594e0, 5.64188496988670089e-1, 2.15311535474403846e-8),
    (1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3, 3.29079923573345963e3, 1.62138957456669019e3, 5.37181101862009858e2, 1.17693950891312499e2, 1.57449261107098347e1, 1.0),
)
FAR = (
    (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2),
    (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725e0, 2.56852019228982242e0, 1.0),
)
CENTRE_ENDS, MIDDLE_ENDS = 0.46875, 4.0


def _scaled(x: Column) -> Column:
    """erfc(x) exp(x^2) for x above CENTRE_ENDS."""
    s = 1 / (x * x)
    far = (1 / math.sqrt(math.pi) - s * _ratio(FAR, s)) / x
    return F.when(x <= MIDDLE_ENDS, _ratio(MIDDLE, x)).otherwise(far)


def erfc(x: Column) -> Column:
    """Complementary error function of a column (best a plain one: it is named many times); null stays null."""
    size = F.abs(x)
    centre = 1 - x * _ratio(CENTRE, x * x)
    tail = F.exp(-size * size) * _scaled(size)
    return F.when(size <= CENTRE_ENDS, centre).when(x > 0, tail).otherwise(2 - tail)


def log_erfc(x: Column) -> Column:
    """Natural logarithm of erfc(x) for x of 0 or more."""
    return F.when(x <= CENTRE_ENDS, F.log(1 - x * _ratio(CENTRE, x * x))).otherwise(F.log(_scaled(x)) - x * x)


def chi2_1_sf(statistic: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom; null stays null."""
    return erfc(F.sqrt(statistic / 2))


def log_chi2_sf(half: Column, df: int) -> Column:
    """Natural logarithm of the upper tail of chi-square with ``df`` (whole) degrees of freedom at 2 * ``half``."""
    shift = 0.0 if df % 2 == 0 else 0.5
    terms = [F.pow(half, F.lit(j + shift)) / math.gamma(j + shift + 1) for j in range(df // 2)]
    if df % 2:
        root = F.sqrt(half)
        terms.insert(0, F.when(root <= CENTRE_ENDS, F.exp(half) * (1 - root * _ratio(CENTRE, half))).otherwise(_scaled(root)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.log(total) - half
