"""Two-sided Student-t p-value as a pure SQL expression.

For integer degrees of freedom the t distribution function has a finite
trigonometric series (Abramowitz & Stegun 26.7.3 / 26.7.4). With
theta = atan(|t| / sqrt(v)):

* v = 1:          A = 2 theta / pi
* v odd  (>= 3):  A = 2/pi * (theta + sin(theta) cos(theta) *
                   sum_{k=0}^{(v-3)/2} d_k cos^{2k} theta),  d_0 = 1, d_k = d_{k-1} * 2k/(2k+1)
* v even:         A = sin(theta) * sum_{k=0}^{(v-2)/2} c_k cos^{2k} theta,
                   c_0 = 1, c_k = c_{k-1} * (2k-1)/(2k)

and the two-sided p-value is 1 - A. Far out (t^2 > v) that difference has no
digits left; there the p-value is the tail series itself, with x = v / (v + t^2)
(the incomplete beta function I_x(v/2, 1/2)):

  p = C_v x^{v/2} sqrt(1 - x) sum_k prod_{j<k} (v + 1 + 2j) / (v + 2 + 2j) x^k,
  C_1 = 2/pi, C_2 = 1/2, C_{v+2} = C_v (v + 1) / (v + 2).

The series are folded with ``aggregate(sequence(...))`` so they stay Catalyst
expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _series(cos2: Column, terms: Column, odd: bool) -> Column:
    """sum_{k=0}^{terms} r_k cos2^k with the ratio recursion above."""
    init = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, k):
        kd = k.cast("double")
        ratio = (2 * kd) / (2 * kd + 1) if odd else (2 * kd - 1) / (2 * kd)
        term = acc["term"] * ratio * cos2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    ks = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ks, init, step, lambda acc: acc["total"])


TAIL_TERMS = 60  # x <= 1/2, so the rest is below 2^-60 of the sum


def _tail(t: Column, v: Column) -> Column:
    vd = v.cast("double")
    x = 1 / (1 + t * t / vd)
    odd = F.pmod(v, F.lit(2)) == 1
    steps = F.when(v >= 3, F.sequence(F.when(odd, 1).otherwise(2), v - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    log_c = F.aggregate(steps, F.when(odd, F.lit(math.log(2 / math.pi))).otherwise(F.lit(math.log(0.5))),
                        lambda acc, u: acc + F.log((u + 1.0) / (u + 2.0)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, j):
        term = acc["term"] * (vd + 1 + 2 * j) / (vd + 2 + 2 * j) * x
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(TAIL_TERMS)), start, step, lambda acc: acc["total"])
    return F.exp(log_c + vd / 2 * F.log(x)) * F.sqrt(1 - x) * series


def t_two_sided_p(t, dof) -> Column:
    """p = P(|T_v| >= |t|) for integer v >= 1. Infinite |t| gives 0; NULL or
    NaN t gives NULL."""
    t, v = _c(t).cast("double"), _c(dof).cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(v.cast("double")))
    s, c = F.sin(theta), F.cos(theta)
    cos2 = c * c
    odd_a = F.when(v == 1, 2 * theta / F.lit(math.pi)).otherwise(
        F.lit(2 / math.pi) * (theta + s * c * _series(cos2, F.floor((v - 3) / 2).cast("int"), True)))
    even_a = s * _series(cos2, F.floor((v - 2) / 2).cast("int"), False)
    a = F.when(F.pmod(v, F.lit(2)) == 1, odd_a).otherwise(even_a)
    p = F.when(t * t > v, _tail(t, v)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - a)))
    return F.when(t.isNull() | F.isnan(t) | v.isNull() | (v < 1), F.lit(None).cast("double")) \
            .when(F.abs(t) == F.lit(float("inf")), F.lit(0.0)).otherwise(p)
