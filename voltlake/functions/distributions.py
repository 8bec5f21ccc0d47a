"""Quantiles of named distributions as column expressions: one registry for draws and for intervals.

Draws feed quantiles with hashed uniforms, so they depend on their keys only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Wichura's algorithm AS 241 (double precision), numerator and denominator from the constant on; centre, middle, tail.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
#: Terms of the series of the normal distribution function; arguments beyond FAR are 0 or 1 to double precision.
TERMS, FAR = 160, 8.3


def _ratio(parts, x: Column) -> Column:
    def horner(cs) -> Column:
        out = F.lit(cs[-1])
        for c in cs[-2::-1]:
            out = out * x + c
        return out

    return horner(parts[0]) / horner(parts[1])


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body's value for a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_quantile(p: Column) -> Column:
    """Of the standard normal, to double precision; null at 0 and 1 and outside."""

    def outer(q: Column) -> Column:
        r = F.sqrt(-F.ln(F.least(q, 1 - q)))
        size = _with(r, lambda r: F.when(r <= 5, _ratio(MIDDLE, r - 1.6)).otherwise(_ratio(TAIL, r - 5)))
        return F.when(q < 0.5, -size).otherwise(size)

    inner = lambda q: (q - 0.5) * _with(0.180625 - (q - 0.5) * (q - 0.5), lambda r: _ratio(CENTRE, r))
    return _with(p, lambda q: F.when((q > 0) & (q < 1), F.when(F.abs(q - 0.5) <= 0.425, inner(q)).otherwise(outer(q))))


def normal_probability(x: Column) -> Column:
    """Distribution function of the standard normal: 1/2 + density * (x + x^3/3 + x^5/15 + ...), whose terms have one sign."""

    def series(v: Column) -> Column:
        start = F.struct(v.alias("term"), v.alias("sum"))
        step = lambda s, k: _with(s["term"] * v * v / (2 * k + 1), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["sum"])
        return 0.5 + total * F.exp(-v * v / 2) / 2.5066282746310002

    return _with(x.cast("double"), lambda v: F.when(v < -FAR, 0.0).when(v > FAR, 1.0).otherwise(series(v)))


def _truncated(p: Column, a: Callable[[int], Column]) -> Column:
    """Between a(2) and a(3); mirrored above the mean, where probabilities are near 1."""
    low, high = (a(2) - a(0)) / a(1), (a(3) - a(0)) / a(1)
    upper = low > 0
    u, v = normal_probability(F.when(upper, -high).otherwise(low)), normal_probability(F.when(upper, -low).otherwise(high))
    z = normal_quantile(u + F.when(upper, 1 - p).otherwise(p) * (v - u))
    return F.least(F.greatest(a(0) + a(1) * F.when(upper, -z).otherwise(z), a(2)), a(3))


def _triangular(p: Column, a: Callable[[int], Column]) -> Column:
    low, mode, high = a(0), a(1), a(2)
    rising = low + F.sqrt(p * (high - low) * (mode - low))
    return F.when(p * (high - low) < mode - low, rising).otherwise(high - F.sqrt((1 - p) * (high - low) * (high - mode)))


#: By name: the quantile of p with arguments: mean and deviation; bounds; mean and deviation of the logarithm; low, mode, high; mean, deviation, low, high; bounds; low and scale; centre and scale.
QUANTILES: dict[str, Callable[[Column, Callable[[int], Column]], Column]] = {
    "normal": lambda p, a: a(0) + a(1) * normal_quantile(p),
    "uniform": lambda p, a: a(0) + p * (a(1) - a(0)),
    "lognormal": lambda p, a: F.exp(a(0) + a(1) * normal_quantile(p)),
    "triangular": _triangular,
    "truncated normal": _truncated,
    "loguniform": lambda p, a: a(0) * F.pow(a(1) / a(0), p),
    "exponential": lambda p, a: a(0) - a(1) * F.ln(1 - p),
    "logistic": lambda p, a: a(0) + a(1) * F.ln(p / (1 - p)),
}


def quantile(kind: Column, p: Column, arguments: Column) -> Column:
    """The quantile of the named distribution with an array of arguments; an unknown name fails the job, null arguments give null."""
    at = lambda k: F.get(arguments, F.lit(k)).cast("double")
    out = F.when(kind.isNull(), F.lit(None).cast("double"))
    for name, f in QUANTILES.items():
        out = out.when(kind == name, f(p, at))
    return out.otherwise(F.raise_error(F.concat(F.lit("no distribution named "), kind)).cast("double"))


def uniform(seed: int, *keys: Column) -> Column:
    """In (0, 1), of the keys only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / float(1 << 53)


def interval(kind: Column, arguments: Column, level: float = 0.95) -> tuple[Column, Column]:
    """The central interval that holds ``level`` of the distribution."""
    tail = (1 - level) / 2
    return quantile(kind, F.lit(tail), arguments), quantile(kind, F.lit(1 - tail), arguments)
