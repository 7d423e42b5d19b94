"""Gamma distribution as Column expressions: logarithm of the gamma function, distribution function, quantiles.

Everything is arithmetic and higher-order functions over short literal arrays, so it stays in the JVM and in the plan.
Below a shape of SMALL the distribution function is its power series. Above, the density of the logarithm, whose width is
about one over the root of the shape, is integrated by Gauss-Legendre quadrature from where it has no mass.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL, NODES, STEPS = 20.0, 40, 8
#: Widths below the mode at which the integral begins.
WIDTHS = 9.5


def log_gamma(a: Column) -> Column:
    """Stirling's series eight places up, and the steps back."""
    z = a + 8
    series = sum((F.lit(c) / F.pow(z, F.lit(k)) for c, k in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7), (1 / 1188, 9), (-691 / 360360, 11))), F.lit(0.0))
    back = a
    for k in range(1, 8):
        back = back * (a + k)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(back)


def gamma_cdf(a: Column, x: Column, log_gamma_a: Column) -> Column:
    """P(X <= x) for a gamma variable of shape a > 0 and scale 1, with x > 0; exact to about 1e-12 where it is between 1e-5
    and 1 - 1e-5. The series has as many terms as x, which isn't far above SMALL there, asks for."""
    add = lambda s, k: F.struct((s["term"] * x / (a + k)).alias("term"), (s["total"] + s["term"] * x / (a + k)).alias("total"))
    start = F.struct((1.0 / a).alias("term"), (1.0 / a).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), (F.least(x, F.lit(9 * SMALL)) * 1.6 + 36).cast("int")), start, add, lambda s: s["total"]) * F.exp(a * F.ln(x) - x - log_gamma_a)
    at, weight = np.polynomial.legendre.leggauss(NODES)
    end, first = F.ln(x / a), -WIDTHS / F.sqrt(a)
    half = (end - first) / 2

    def term(total, node):
        u = first + half * (node["at"] + 1)
        return total + node["weight"] * F.exp(a * (u - F.expm1(u)))

    nodes = F.array(*(F.struct(F.lit(float(t)).alias("at"), F.lit(float(w)).alias("weight")) for t, w in zip(at, weight, strict=True)))
    integral = half * F.aggregate(nodes, F.lit(0.0), term) * F.exp(a * F.ln(a) - a - log_gamma_a)
    return F.when(a < SMALL, series).otherwise(F.when(end > first, integral).otherwise(0.0))


def gamma_quantile(p: float, shape: Column, scale: Column | float = 1.0) -> Column:
    """The value below which a share p lies, 1e-5 < p < 1 - 1e-5; null where shape or scale is null or not positive. From
    Wilson and Hilferty's approximation, Halley's steps until they change nothing, STEPS at most."""
    z, scale = NormalDist().inv_cdf(p), F.lit(scale) if isinstance(scale, float) else scale
    known = (shape > 0) & (scale > 0)

    def of(s: Column) -> Column:
        """s: struct a, g (log gamma of a)."""
        a, g = s["a"], s["g"]
        cube = 1.0 - 1.0 / (9.0 * a) + z / (3.0 * F.sqrt(a))
        small = F.exp((math.log(p) + g + F.ln(a)) / a)  # of the series' first term
        start = F.when((a > 0.5) & (cube > 0.1), a * cube * cube * cube).otherwise(small)

        def step(s, _):
            x = s["x"]

            def halley(ratio):
                new = x - ratio / (1.0 - 0.5 * F.least(F.lit(1.0), ratio * ((a - 1.0) / x - 1.0)))
                return F.struct(F.when(new > 0, new).otherwise(x / 2).alias("x"), (F.abs(ratio) < 1e-5 * x).alias("done"))  # its error is cubed

            density = F.exp((a - 1.0) * F.ln(x) - x - g)
            ratio = (gamma_cdf(a, x, g) - p) / F.greatest(density, F.lit(1e-300))
            return F.when(s["done"], s).otherwise(F.transform(F.array(ratio), halley)[0])

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(start.alias("x"), F.lit(False).alias("done")), step, lambda s: s["x"])

    a = F.when(known, shape.cast("double"))
    bound = F.transform(F.array(F.struct(a.alias("a"), log_gamma(a).alias("g"))), of)[0]
    return F.when(known, bound * scale)
