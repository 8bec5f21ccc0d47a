"""Aggregates over segments, curves, spectra, posterior samples and runs."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltlake.functions.ocv import slope_unit
from voltlake.operators.joins import join_interp
from voltlake.operators.segments import SEG, SLICE, numbered, ordered, running, with_halo, within
from voltlake.operators.storage import staged

@functools.lru_cache
def chi2_95(degrees: int) -> float:
    """95 % quantile of chi-squared; its distribution function is a finite sum for whole degrees, halved on until it stands still."""

    def above(x: float) -> float:
        h = x / 2
        if degrees % 2 == 0:
            term = total = math.exp(-h)
            for k in range(1, degrees // 2):
                term *= h / k
                total += term
            return total
        total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
        for k in range(1, (degrees - 1) // 2 + 1):
            total += term
            term *= h / (k + 0.5)
        return total

    low, high = 0.0, degrees + 10 * math.sqrt(2 * degrees) + 20
    while True:
        middle = 0.5 * (low + high)
        if not low < middle < high:
            return middle
        low, high = (middle, high) if above(middle) > 0.05 else (low, middle)


def segment_stats(df: DataFrame) -> DataFrame:
    return df.groupBy(*SEG).agg(*[f(c).alias(f"{c}_{n}") for c in ("i", "u") for n, f in (("mean", F.avg), ("var", F.var_pop))])


def segment_span(df: DataFrame) -> DataFrame:
    d = df.groupBy(*SEG).agg((F.max("t") - F.min("t")).alias("duration"), F.min_by("u", "pt").alias("u_first"), F.max_by("u", "pt").alias("u_last"), F.avg("i").alias("i_mean"), F.avg(F.abs("i")).alias("i_abs"), F.stddev_pop("u").alias("u_std"))
    return d


def protocol_classify(df: DataFrame, flip: bool = False, eps: float = 1e-8) -> DataFrame:
    """Adds ``step``: Rest without current, Hold at constant voltage, else Discharge or Charge by the mean current's sign."""
    mean = -F.col("i_mean") if flip else F.col("i_mean")
    step = F.when(F.col("i_abs") < eps, "Rest").when(F.col("u_std") < eps, "Hold").when(mean > 0, "Discharge").otherwise("Charge")
    return segment_span(df).withColumn("step", step)


def four_digits(x: Column) -> Column:
    """Four significant digits without trailing zeros; halves go up."""
    short = F.format_string("%.3e", x * 1.000000000001).cast("double")
    text = F.regexp_replace(F.format_string("%.9f", short), "0+$", "")
    return F.regexp_replace(text, "\\.$", "")


def duration_text(seconds: Column) -> Column:
    day, hour, minute = seconds >= 86400, seconds >= 3600, seconds >= 60
    size = F.when(day, 86400.0).when(hour, 3600.0).when(minute, 60.0).otherwise(1.0)
    return F.concat(four_digits(seconds / size), F.when(day, " d").when(hour, " h").when(minute, " m").otherwise(" s"))


def protocol_text(df: DataFrame) -> DataFrame:
    """Adds ``text``: the step in words."""
    spans = protocol_classify(df)
    number = four_digits(F.when(F.col("step") == "Hold", F.col("u_last")).otherwise(F.abs("i_mean")))
    level = F.when(F.col("step") == "Rest", "").otherwise(F.concat(F.lit(" at "), number, F.when(F.col("step") == "Hold", " V").otherwise(" A")))
    return spans.withColumn("text", F.concat(F.col("seg_pos").cast("string"), F.lit(": "), F.col("step"), level, F.lit(" for "), duration_text(F.col("duration"))))


def with_charge(df: DataFrame, rule: str = "trapezoid", absolute: bool = False) -> DataFrame:
    """Adds ``charge``: the running integral of the current in each segment; rule trapezoid or right."""
    w = within(*SEG)
    i = F.abs("i") if absolute else F.col("i")
    height = 0.5 * (F.lag(i).over(w) + i) if rule == "trapezoid" else i
    d = df.withColumn("_q", F.coalesce(height * (F.col("t") - F.lag("t").over(w)), F.lit(0.0)))
    return d.withColumn("charge", F.sum("_q").over(running(*SEG))).drop("_q")


def charge_throughput(df: DataFrame, per: float = 1.0, rule: str = "trapezoid") -> DataFrame:
    return with_charge(df, rule).groupBy(*SEG).agg((F.max_by("charge", "pt") / per).alias("charge"))


def cc_cv_curves(df: DataFrame, charge: int, hold: int, discharge: int) -> DataFrame:
    """meas_id, kind, x (Ah), u, i of the charge and discharge segments; charge starts at the hold's charge k, discharge is shifted by -k and cut at 0."""
    d = with_charge(df, absolute=True).withColumn("x", F.col("charge") / 3600)
    k = d.filter(F.col("seg_pos") == hold).groupBy("meas_id").agg(F.max("x").alias("k"))
    d = d.filter(F.col("seg_pos").isin(charge, discharge)).join(k, "meas_id")
    kind = F.when(F.col("seg_pos") == charge, "charge").otherwise("discharge")
    d = d.withColumn("kind", kind).withColumn("x", F.col("x") - F.min("x").over(Window.partitionBy(*SEG)))
    d = d.withColumn("x", F.when(F.col("kind") == "charge", F.col("x") + F.col("k")).otherwise(F.col("x") - F.col("k")))
    return d.filter((F.col("kind") == "charge") | (F.col("x") >= 0)).select("meas_id", "kind", "pt", "x", "u", "i")


def cc_cv_capacity(curves: DataFrame) -> DataFrame:
    """meas_id, low, high (range that both curves cover), i_mean."""
    per = curves.groupBy("meas_id").pivot("kind", ["charge", "discharge"]).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("i").alias("i"))
    return per.select("meas_id", F.greatest("charge_lo", "discharge_lo").alias("low"), F.least("charge_hi", "discharge_hi").alias("high"), (0.5 * F.col("charge_i") - 0.5 * F.col("discharge_i")).alias("i_mean")).dropna()


def on_grid(curves: DataFrame, ranges: DataFrame, points: int) -> DataFrame:
    """meas_id, kind, k, x, y: each curve at ``points`` equidistant x over its measurement's range."""
    grid = ranges.filter("high > low").select("meas_id", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    # the ends are knots of one of the curves, so they are taken as they are
    x = F.when(F.col("k") == points - 1, F.col("high")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("k") / (points - 1))
    grid = grid.select("meas_id", "k", x.alias("x"), F.explode(F.array(F.lit("charge"), F.lit("discharge"))).alias("kind"))
    return join_interp(grid, curves.select("meas_id", "kind", "x", F.col("u").alias("y")), ["meas_id", "kind"])


def mean_ocv(curves: DataFrame, points: int = 9) -> DataFrame:
    """meas_id, k, x, u: the mean of charge and discharge curve."""
    at = on_grid(curves, cc_cv_capacity(curves), points)
    both = at.groupBy("meas_id", "k").agg(F.min("x").alias("x"), F.sum("y").alias("s"), F.count("y").alias("n"))
    return both.select("meas_id", "k", "x", F.when(F.col("n") == 2, 0.5 * F.col("s")).alias("u"))


def qocv_second_difference(curves: DataFrame, quasi: DataFrame, points: int = 9) -> DataFrame:
    """meas_id, k, d: charge + discharge - 2 * quasi-OCV (meas_id, x, y) on the common grid."""
    at = on_grid(curves, cc_cv_capacity(curves), points)
    both = at.groupBy("meas_id", "k").agg(F.min("x").alias("x"), F.sum("y").alias("s"), F.count("y").alias("n"))
    q = join_interp(both.select("meas_id", "k", "x", "s", "n"), quasi, ["meas_id"])
    return q.select("meas_id", "k", F.when(F.col("n") == 2, F.col("s") - 2 * F.col("y")).alias("d"))


def incremental_capacity(df: DataFrame, width: float) -> DataFrame:
    """meas_id, seg_pos, u_bin, dsoc_du: change of the normalised charge over bins of the voltage."""
    d = with_charge(df, absolute=True)
    total = F.max("charge").over(Window.partitionBy(*SEG))
    d = d.withColumn("soc", F.col("charge") / F.nullif(total, F.lit(0.0))).withColumn("u_bin", F.floor(F.col("u") / width).cast("int"))
    bins = d.groupBy(*SEG, "u_bin").agg(F.avg("soc").alias("soc"), F.avg("u").alias("u"))
    w = Window.partitionBy(*SEG).orderBy("u_bin")
    slope = (F.lead("soc").over(w) - F.col("soc")) / F.nullif(F.lead("u").over(w) - F.col("u"), F.lit(0.0))
    return bins.withColumn("dsoc_du", slope).select(*SEG, "u_bin", "dsoc_du")


def _per_frequency(df: DataFrame, keys: Sequence[str], name: str, labels: Sequence[int], terms: Sequence[tuple[Column, Column]]) -> DataFrame:
    """keys, name, re, im: the sums of each label's two terms, as columns of one aggregation, so no point is copied for each frequency."""
    sums = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_{part}{k}") for k, pair in enumerate(terms) for part, c in zip(("re", "im"), pair, strict=True)])
    rows = [F.struct(F.lit(v).alias(name), F.col(f"_re{k}").alias("re"), F.col(f"_im{k}").alias("im")) for k, v in enumerate(labels)]
    return sums.select(*keys, F.explode(F.array(*rows)).alias("_f")).select(*keys, "_f.*")


def laplace(df: DataFrame, keys: Sequence[str], x: str, y: str, s: Sequence[tuple[float, float]], slice_rows: int = SLICE) -> DataFrame:
    """keys, k, re, im: sum of y_mid * exp(-s x_mid) * dx for each complex s; a key's points in slices (order: pt)."""
    d = with_halo(numbered(df.select(*keys, "pt", F.col(x).alias("_x"), F.col(y).alias("_y")), keys, "_k", slice_points=slice_rows), "_k", 1, 0, slice_rows)
    w = within(*keys, "_s", order=("_k",))
    d = d.withColumn("_m", (F.col("_x") + F.lag("_x").over(w)) / 2).withColumn("_v", (F.col("_y") + F.lag("_y").over(w)) / 2 * (F.col("_x") - F.lag("_x").over(w)))
    d = d.filter("not _halo").filter("_m is not null")
    size = lambda a: F.col("_v") * F.exp(-a * F.col("_m"))
    return _per_frequency(d, keys, "k", range(len(s)), [(size(a) * F.cos(b * F.col("_m")), -size(a) * F.sin(b * F.col("_m"))) for a, b in s])


def dft_at_frequency(df: DataFrame, keys: Sequence[str], n: Column, length: Column, y: str, bins: Sequence[int]) -> DataFrame:
    """keys, bin, re, im of the discrete Fourier transform at the given bins."""
    d = df.withColumn("_a", 6.283185307179586 * n / length)
    return _per_frequency(d, keys, "bin", bins, [(F.col(y) * F.cos(b * F.col("_a")), -F.col(y) * F.sin(b * F.col("_a"))) for b in bins])


def peaks(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, pt, x, y, area of each local maximum; the ends count when positive, taken one point inside.

    area: trapezoids over the maximum and its neighbours, padded by zeros; the axis is extended linearly at the ends.
    """
    w = within(*keys)
    d = df.withColumn("_last", F.max("pt").over(Window.partitionBy(*keys)))
    around = {}
    for k in (1, 2):
        around |= {f"_xb{k}": F.lag(x, k).over(w), f"_xa{k}": F.lead(x, k).over(w)}
    d = d.withColumns(around | {"_yb": F.lag(y).over(w), "_ya": F.lead(y).over(w)})
    first, last = F.lag(y).over(w).isNull(), F.lead(y).over(w).isNull()
    d = d.withColumn("_first_up", F.lag(F.when(first & (F.col(y) > 0), 1).otherwise(0)).over(w)).withColumn("_last_up", F.lead(F.when(last & (F.col(y) > 0), 1).otherwise(0)).over(w))
    inner = (F.col("_yb") < F.col(y)) & (F.col("_ya") < F.col(y))
    d = d.filter(F.coalesce(inner, F.lit(False)) | (F.coalesce("_first_up", F.lit(0)) == 1) | (F.coalesce("_last_up", F.lit(0)) == 1)).filter("_yb is not null and _ya is not null")
    xb2 = F.coalesce("_xb2", 2 * F.col("_xb1") - F.col(x))
    xa2 = F.coalesce("_xa2", 2 * F.col("_xa1") - F.col(x))
    v = F.col(y)
    area = (0 + F.col("_yb")) / 2 * (F.col("_xb1") - xb2) + (F.col("_yb") + v) / 2 * (F.col(x) - F.col("_xb1")) + (v + F.col("_ya")) / 2 * (F.col("_xa1") - F.col(x)) + (F.col("_ya") + 0) / 2 * (xa2 - F.col("_xa1"))
    return d.select(*keys, "pt", F.col(x).alias("x"), v.alias("y"), area.alias("area"))


def topk_peaks(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first n rows per key, or the last -n; adds rank from 1."""
    by = Window.partitionBy(*keys).orderBy(F.col(order).asc() if n > 0 else F.col(order).desc())
    return df.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= abs(n))


def sort_curve(df: DataFrame, keys: Sequence[str], soc: str, ocv: str) -> DataFrame:
    """Adds ord: position by (SOC, OCV), turned round where the voltage would rise; a SOC that is never positive changes sign."""
    w = Window.partitionBy(*keys)
    d = df.withColumn(soc, F.when(F.max(soc).over(w) <= 0, -F.col(soc)).otherwise(F.col(soc)))
    order = Window.partitionBy(*keys).orderBy(soc, ocv)
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_up", F.last(ocv).over(full) > F.first(ocv).over(full))
    return d.withColumn("ord", F.when(F.col("_up"), F.col("_n") - 1 - F.col("_r")).otherwise(F.col("_r"))).drop("_r", "_n", "_up")


def plateau_order(df: DataFrame, keys: Sequence[str], near: float = 1e-4) -> DataFrame:
    """Plateaus (k, e0, dx) by falling e0; a null last dx becomes what is left of 1; ``close`` warns of coinciding neighbours."""
    order = Window.partitionBy(*keys).orderBy(F.desc("e0"), "k")
    left = 1 - F.sum(F.coalesce("dx", F.lit(0.0))).over(Window.partitionBy(*keys))
    return df.withColumn("pos", F.row_number().over(order) - 1).withColumn("close", F.coalesce(F.abs(F.lead("e0").over(order) - F.col("e0")) < near, F.lit(False))).withColumn("dx", F.coalesce("dx", left))


def feature_shuffle(df: DataFrame, keys: Sequence[str], feature: str, seed: int) -> DataFrame:
    """Adds ord: a permutation of the features, the same in each pass with a seed."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(feature))), feature)) - 1)


def sample_moments(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, i, j, mean_i, mean_j, cov, corr of the sample columns for i <= j: one pass, one row per key until it is unpacked."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    one = df.groupBy(*keys).agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"m_{a}").alias("mean_i"), F.col(f"m_{b}").alias("mean_j"), F.col(f"c_{a}_{b}").alias("cov"), (F.col(f"c_{a}_{b}") / F.sqrt(F.nullif(F.col(f"c_{a}_{a}") * F.col(f"c_{b}_{b}"), F.lit(0.0)))).alias("corr")) for a, b in pairs])
    return one.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def correlation_across_runs(corr: DataFrame) -> DataFrame:
    """i, j, mean, std of correlations over runs, and mean / std (1 on the diagonal)."""
    d = corr.groupBy("i", "j").agg(F.avg("corr").alias("mean"), F.stddev_samp("corr").alias("std"))
    return d.withColumn("boosted", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("mean") / F.nullif(F.col("std"), F.lit(0.0))))


def error_bounds(df: DataFrame, mean: str, std: str, dimensions: int, kind: Column) -> DataFrame:
    """Adds low and high: mean -/+ sqrt(chi2) * std, back-transformed (exp where kind is log)."""
    k = chi2_95(dimensions) ** 0.5
    back = lambda c: F.when(kind == "log", F.exp(c)).otherwise(c)
    return df.withColumn("low", back(F.col(mean) - k * F.col(std))).withColumn("high", back(F.col(mean) + k * F.col(std)))


def mean_std_transformed(df: DataFrame, mean: str, std: str, kind: Column, k: float) -> DataFrame:
    """Adds m, s, low, high after back-transformation; of a logarithm in closed form."""
    mu, sd = F.col(mean), F.col(std)
    log = kind == "log"
    m = F.when(log, F.exp(mu + sd * sd / 2)).otherwise(mu)
    s = F.when(log, F.sqrt((F.exp(sd * sd) - 1) * F.exp(2 * mu + sd * sd))).otherwise(sd)
    return df.withColumns({"m": m, "s": s, "low": F.when(log, F.exp(mu - k * sd)).otherwise(mu - k * sd), "high": F.when(log, F.exp(mu + k * sd)).otherwise(mu + k * sd)})


def geo_mean_dev(df: DataFrame, keys: Sequence[str], deviation: Column) -> DataFrame:
    """keys, mean, low, high: geometric mean and one geometric standard deviation each way of a positive deviation."""
    d = df.withColumn("_l", F.ln(F.when(deviation > 0, deviation)))
    per = d.groupBy(*keys).agg(F.avg("_l").alias("m"), F.stddev_pop("_l").alias("s"))
    return per.select(*keys, F.exp("m").alias("mean"), F.exp(F.col("m") - F.col("s")).alias("low"), F.exp(F.col("m") + F.col("s")).alias("high"))


def sensitivity(df: DataFrame, dimensions: int = 4) -> DataFrame:
    """Adds sensitivity of features (f at the estimate, f_lo, f_hi at its bounds) to a parameter with bounds lo, hi."""
    delta = F.abs(F.ln("hi") - F.ln("lo")) / chi2_95(dimensions) ** 0.5
    norm = 0.5 * (F.ln("lo") + F.ln("hi"))
    return df.withColumn("sensitivity", F.abs(norm * F.abs(F.col("f_hi") - F.col("f_lo")) / (delta * F.col("f"))))


def envelope(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(y).alias("low"), F.max(y).alias("high"), F.count(F.lit(1)).alias("runs"))


def chain_diagnostics(df: DataFrame, keys: Sequence[str], chain: str, x: str) -> DataFrame:
    """keys, r_hat of chains (Gelman and Rubin), from between and within variance."""
    per = df.groupBy(*keys, chain).agg(F.avg(x).alias("m"), F.var_samp(x).alias("v"), F.count(F.lit(1)).alias("n"))
    both = per.groupBy(*keys).agg(F.var_samp("m").alias("b"), F.avg("v").alias("w"), F.avg("n").alias("n"))
    return both.select(*keys, F.sqrt((F.col("n") - 1) / F.col("n") + F.col("b") / F.nullif(F.col("w"), F.lit(0.0))).alias("r_hat"))


def effective_sample_size(df: DataFrame, keys: Sequence[str], order: str, x: str, lags: int = 20, slice_rows: int = SLICE) -> DataFrame:
    """keys, ess: n / (1 + 2 * sum of the positive first autocorrelations, up to the first that isn't).

    ``lags`` at a time: keys whose correlations are all positive so far go on with the next ones, until none is left. Products run in slices of a
    key that begin with the last rows of the slice before, so a long chain is many tasks.
    """
    means = df.groupBy(*keys).agg(F.avg(x).alias("_m"))
    d = ordered(df.select(*keys, F.col(order).alias("_order"), F.col(x).alias("_x")), keys, ["_order"], "_o")
    d = staged(d.join(means, list(keys)).select(*keys, (F.col("_x") - F.col("_m")).alias("_d"), "_o"), "deviations")
    at, done, found = 0, [], None
    while True:
        span = range(at + 1, at + lags + 1)
        sums = d if found is None else d.join(found.filter("_on").select(*keys, F.col("_s").alias("_before")), list(keys))
        w = Window.partitionBy(*keys, "_s").orderBy("_o")
        sums = with_halo(sums, "_o", at + lags, 0, max(slice_rows, at + lags)).withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in span}).filter("not _halo")
        before = F.lit(0.0) if found is None else F.first("_before")
        per = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("v"), before.alias("_before"), *[F.sum(f"_p{k}").alias(f"_a{k}") for k in span])
        rho = F.array(*[F.coalesce(F.col(f"_a{k}") / F.nullif("v", F.lit(0.0)), F.lit(0.0)) for k in span])
        start = F.struct(F.col("_before").alias("s"), F.lit(True).alias("on"))
        total = F.aggregate(rho, start, lambda a, r: F.struct((a["s"] + F.when(a["on"] & (r > 0), r).otherwise(0.0)).alias("s"), (a["on"] & (r > 0)).alias("on")))
        found = staged(per.select(*keys, "n", total.alias("_t")).select(*keys, "n", F.col("_t.s").alias("_s"), F.col("_t.on").alias("_on")), "correlations")
        done.append(found.filter("not _on"))
        at += lags
        if found.filter("_on").isEmpty():
            break
    out = functools.reduce(DataFrame.unionByName, done)
    return out.select(*keys, (F.col("n") / (1 + 2 * F.col("_s"))).alias("ess"))


def residual_measures(df: DataFrame, keys: Sequence[str], error: Column) -> DataFrame:
    """keys, root_sum_sq, rmse, mae, max_abs of the errors."""
    d = df.withColumn("_e", error)
    x = F.col("_e")
    return d.groupBy(*keys).agg(F.sqrt(F.sum(x * x)).alias("root_sum_sq"), F.sqrt(F.avg(x * x)).alias("rmse"), F.avg(F.abs(x)).alias("mae"), F.max(F.abs(x)).alias("max_abs"))


#: Candidates up to which each point is held against all of them in place.
MOST_CANDIDATES = 10_000


def ocv_losses(points: DataFrame, candidates: DataFrame, keys: Sequence[str], order: float = 2.0, temperature: float = 298.15) -> DataFrame:
    """keys, candidate, loss of every candidate OCV model on every key's points.

    points: keys, e (voltage), soc, and weight if there is one. candidates: candidate, plateaus (array of e0, a, dx), start and end of the SOC range; a table of
    models, at most MOST_CANDIDATES. The loss is the sum of (weight |model - soc|)^order / (1 + |slope|^order), to the power 1 / order; of
    infinite ``order`` the largest weight |model - soc|.
    """
    if candidates.count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates; hold them against the points in parts")
    unit, weight = slope_unit(temperature=temperature), F.col("weight") if "weight" in points.columns else F.lit(1.0)
    held = candidates.agg(F.collect_list(F.struct("candidate", "plateaus", "start", "end")).alias("_all"))
    d = points.select(*keys, "e", "soc", weight.alias("_w")).join(F.broadcast(held)).withColumn("_c", F.explode("_all")).drop("_all")
    grown = lambda p: F.exp(F.greatest(F.least((F.col("e") - p["e0"]) * p["a"] * unit, F.lit(700.0)), F.lit(-700.0)))
    zero, width = F.struct(F.lit(0.0).alias("soc"), F.lit(0.0).alias("slope")), F.col("_c.end") - F.col("_c.start")
    step = lambda s, p: F.get(F.transform(F.array(grown(p)), lambda x: F.struct((s["soc"] + p["dx"] / (1 + x)).alias("soc"), (s["slope"] + p["dx"] * p["a"] * unit * x / ((1 + x) * (1 + x))).alias("slope"))), F.lit(0))
    d = d.withColumn("_m", F.aggregate("_c.plateaus", zero, step))
    off = F.abs(F.col("_w") * (F.col("_c.start") + F.col("_m.soc") * width - F.col("soc")))
    by = d.groupBy(*keys, F.col("_c.candidate").alias("candidate"))
    if order == float("inf"):
        return by.agg(F.max(off).alias("loss"))
    return by.agg(F.pow(F.sum(F.pow(off, F.lit(order)) / (1 + F.pow(F.abs(F.col("_m.slope") * width), F.lit(order)))), F.lit(1 / order)).alias("loss"))


def ocv_subtract(df: DataFrame, ocv: Column, sign: float = 1.0) -> DataFrame:
    """Adds overpotential: u - sign * OCV(SOC); segments whose current is zero throughout keep the last OCV before them (the first: its own).

    In two levels: each segment's last OCV inside segments, then the last of a segment with current over the few segments.
    """
    d = df.withColumn("_own", ocv)
    per = d.groupBy(*SEG).agg((F.max(F.abs("i")) == 0).alias("_idle"), F.max_by("_own", "pt").alias("_end"), F.min_by("_own", "pt").alias("_begin"))
    order = Window.partitionBy("meas_id").orderBy("seg_pos")
    before = F.last(F.when(~F.col("_idle"), F.col("_end")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_begin").over(order.rowsBetween(Window.unboundedPreceding, 0))
    per = per.select(*SEG, "_idle", F.coalesce(before, first).alias("_held"))
    used = F.when(F.col("_idle"), F.col("_held")).otherwise(F.col("_own"))
    return d.join(per, SEG).withColumn("overpotential", F.col("u") - sign * used).drop("_own", "_idle", "_held")


def ocv_mismatch_ramp(df: DataFrame, mismatch: DataFrame) -> DataFrame:
    """Adds corrected: over a pulse (even segment) the mismatch of the rest before runs linearly into that of the rest behind; over a rest its own is subtracted.

    ``mismatch``: meas_id, seg_pos (odd), m. The first pulse starts at its own end mismatch.
    """
    w = Window.partitionBy("meas_id").orderBy("seg_pos")
    ramps = mismatch.withColumn("m0", F.coalesce(F.lag("m").over(w), F.col("m")))
    rests = ramps.select("meas_id", "seg_pos", F.col("m").alias("m0"), "m")
    pulses = ramps.select("meas_id", (F.col("seg_pos") - 1).alias("seg_pos"), "m0", "m")
    s = Window.partitionBy(*SEG).orderBy("pt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    span = F.last("t").over(s) - F.first("t").over(s)
    tau = F.coalesce((F.col("t") - F.first("t").over(s)) / F.nullif(span, F.lit(0.0)), F.lit(0.0))
    d = df.withColumn("_tau", tau).join(rests.unionByName(pulses), SEG)
    return d.withColumn("corrected", F.col("u") - (1 - F.col("_tau")) * F.col("m0") - F.col("_tau") * F.col("m")).drop("_tau", "m0", "m")
