"""Cauchy combination of p-values as an aggregate expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cauchy(p: Column | str, weight: Column | float = 1.0) -> Column:
    """Combined p-value of a group.

    Any exact 0 gives 0, any exact 1 gives 1, both together null. Null and NaN p-values make the
    result null, as does a group without positive weight.
    """
    p = F.col(p) if isinstance(p, str) else p
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    tiny = p < 1e-16
    part = F.when(tiny, w / (F.when(p > 0, p) * math.pi)).otherwise(w * F.tan((0.5 - p) * math.pi))
    total = F.sum(w)
    t = F.sum(part) / F.when(total > 0, total)
    zero, one = F.bool_or(p == 0), F.bool_or(p == 1)
    bad = F.bool_or(p.isNull() | F.isnan(p))
    tail = F.when(t > 1e15, 1 / (t * math.pi)).when(F.abs(t) <= 1, 0.5 - F.atan(t) / math.pi).otherwise(F.atan(1 / F.when(t != 0, t)) / math.pi + F.when(t <= 0, 1.0).otherwise(0.0))
    return F.when(bad | (zero & one), None).when(zero, 0.0).when(one, 1.0).otherwise(tail)


def cauchy_spa(p: Column | str) -> Column:
    """Combination for saddlepoint p-values: null, NaN and 1 are left out; 1 if nothing (or only zeros) is left."""
    p = F.col(p) if isinstance(p, str) else p
    kept = F.when(p.isNotNull() & ~F.isnan(p) & (p < 1), p)
    some = F.coalesce(F.sum(kept), F.lit(0.0)) > 0
    return F.when(some, cauchy(F.coalesce(kept, F.lit(0.5)), F.when(kept.isNotNull(), 1.0).otherwise(0.0))).otherwise(1.0)
