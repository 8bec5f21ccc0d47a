"""Operators over spectra: candidate models and evaluation grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_rc_discrepancy(spectra: DataFrame, theta: Sequence[tuple[float, float, float, float, float]]) -> DataFrame:
    """meas_id, k, discrepancy, log_likelihood of two-RC models (ln resistance, two shares, two places) for every spectrum.

    The places are in units of the spread of the log frequencies around their mean, over all distinct frequencies.
    """
    d = spectra.withColumn("lf", F.ln("f"))
    # the scale of the axis: one row, from the distinct frequencies
    scale = d.select("pt", "lf").distinct().agg(F.avg("lf").alias("m"), F.stddev_samp("lf").alias("s"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(n) for n, v in zip("t0 t1 t2 a b".split(), t, strict=True)]) for k, t in enumerate(theta)])
    d = d.join(F.broadcast(scale)).withColumn("t", F.explode(rows))
    rt, r1, r2 = F.exp("t.t0"), F.exp(-F.exp("t.t1")), F.exp(-F.exp("t.t2"))
    x1, x2 = (F.col("lf") - (F.col("s") * F.col(f"t.{c}") + F.col("m")) for c in "ab")
    re = rt * (1 - r1 - r2 + r1 / 2 * (1 - F.tanh(x1)) + r2 / 2 * (1 - F.tanh(x2)))
    im = rt * (r1 / 2 / F.cosh(x1) + r2 / 2 / F.cosh(x2))
    error = (F.col("re") - re) * (F.col("re") - re) + (F.col("im") - im) * (F.col("im") - im)
    per = d.groupBy("meas_id", F.col("t.k").alias("k")).agg(F.sum(error).alias("e"), F.count(F.lit(1)).alias("n"))
    e, n = F.col("e"), F.col("n")
    return per.select("meas_id", "k", (-F.ln(e / (2 * n))).alias("discrepancy"), (-n * (1 + F.ln(3.141592653589793 / n * e))).alias("log_likelihood"))


def grid(df: DataFrame, low: str, high: str, points: int, log: bool) -> DataFrame:
    """Each row ``points`` times, with k and x: equidistant, or equidistant in the logarithm."""
    a, b = (F.ln(low), F.ln(high)) if log else (F.col(low), F.col(high))
    x = a + (b - a) * F.col("k") / (points - 1)
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.exp(x) if log else x)
