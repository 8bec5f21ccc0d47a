"""Grouped fits in closed form: for each candidate rate a linear regression, then the best candidate, in rounds that narrow a bracket.

Points of a short segment are fewer bytes than its candidates' sums: they are brought together once, a row per segment, and all rounds run over
arrays of a batch of such rows. Sums per (long segment, candidate) are partial before the shuffle, so what moves is a few numbers per segment and
candidate, whatever its length; a round's brackets are one small row per segment, joined back to the points (broadcast where adaptive execution finds them small).
Leading stretches are fitted from prefix moments: running sums inside slices of a segment, and a prefix over the slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voltlake.operators.joins import pair_pulse_rest
from voltlake.operators.segments import SEG, SLICE, coulomb_count, ir_step, keep_window, numbered, running, segment_ends, trim_head
from voltlake.operators.storage import staged

LEAST_POINTS = 4
#: Rounds after the first, and the candidates of each: a bracket shrinks to 2/23 in a round.
ROUNDS, FINE = 3, 24
#: Squares within this share of the least, or of those of y, count as equal: what is left then is rounding.
TIE, EXACT = 1e-9, 1e-11
#: Points of a segment that is fitted in one row; points of the rows that arrays hold at once.
SHORT, AT_ONCE = 1024, 1 << 18
#: Long segments whose keys are broadcast.
BROADCAST = 100_000


def since_start(df: DataFrame) -> DataFrame:
    """Adds tau (seconds since the segment's start), span (its duration) and n (its points): an aggregate joined back."""
    ends = df.groupBy(*SEG).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.count(F.lit(1)).alias("n"))
    d = df.join(ends, SEG).withColumn("tau", F.col("t") - F.col("_t0"))
    return d.withColumn("span", F.col("_t1") - F.col("_t0")).drop("_t0", "_t1")


#: regressor(m, g, c): the regressor of candidate g, c(name) being a column; m is the functions of Spark, or NumPy where columns are arrays.
Regressor = Callable[[ModuleType, object, Callable[[str], object]], object]


class Linear:
    """b, c, sse, syy of _y = b + c * _x."""

    fields, whole = ("b", "c", "sse", "syy"), True

    def sums(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        per = df.groupBy(*keys).agg(
            F.regr_intercept("_y", "_x").alias("b"), F.regr_slope("_y", "_x").alias("c"),
            F.regr_sxx("_y", "_x").alias("sxx"), F.regr_sxy("_y", "_x").alias("sxy"), F.regr_syy("_y", "_x").alias("syy"), F.count("_x").alias("n"),
        )
        per = per.filter((F.col("n") >= LEAST_POINTS) & (F.col("sxx") > 0))
        return per.withColumn("sse", F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")))

    def arrays(self, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, ...]]:
        def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first = v[starts]  # so that equal values have no squares at all
            off = v - np.repeat(first, sizes)
            mean = np.add.reduceat(off, starts) / sizes
            return off - np.repeat(mean, sizes), first + mean

        v, ym = centred(y)
        syy = np.add.reduceat(v * v, starts)

        def fit(x: np.ndarray) -> tuple[np.ndarray, ...]:
            u, xm = centred(x)
            sxx, sxy = np.add.reduceat(u * u, starts), np.add.reduceat(u * v, starts)
            c = sxy / sxx
            return sxx, ym - c * xm, c, np.maximum(0.0, syy - sxy * sxy / sxx), syy

        return fit


class Origin:
    """k, sse, syy of _y = k * _x with k clipped to [low, high]."""

    fields, whole = ("k", "sse", "syy"), False

    def __init__(self, low: float, high: float):
        self.low, self.high = low, high

    def sums(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        x, v = F.col("_x"), F.col("_y")
        d = df.groupBy(*keys).agg(F.sum(x * v).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(v * v).alias("syy"), F.count(x).alias("n"))
        d = d.filter((F.col("n") >= LEAST_POINTS) & (F.col("sxx") > 0))
        d = d.withColumn("k", F.least(F.greatest(F.col("sxy") / F.col("sxx"), F.lit(self.low)), F.lit(self.high)))
        return d.withColumn("sse", F.greatest(F.lit(0.0), F.col("syy") - 2 * F.col("k") * F.col("sxy") + F.col("k") * F.col("k") * F.col("sxx")))

    def arrays(self, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, ...]]:
        syy = np.add.reduceat(y * y, starts)

        def fit(x: np.ndarray) -> tuple[np.ndarray, ...]:
            sxx, sxy = np.add.reduceat(x * x, starts), np.add.reduceat(x * y, starts)
            k = np.fmin(np.maximum(sxy / sxx, self.low), self.high)
            return sxx, k, np.maximum(0.0, syy - 2 * k * sxy + k * k * sxx), syy

        return fit


def tries_of(grid: Sequence[float]) -> list[tuple[float, float, float]]:
    """(g, lo, hi) of the first round: each value and its neighbours."""
    return sorted((float(g), float(grid[max(0, k - 1)]), float(grid[min(len(grid) - 1, k + 1)])) for k, g in enumerate(grid))


def between(m: ModuleType, lo, hi, k: int, log: bool):
    """The k-th of FINE values from lo to hi, evenly in the logarithm or plainly."""
    return lo * m.power(hi / lo, k / (FINE - 1)) if log else lo + (hi - lo) * (k / (FINE - 1))


def bracketed(df: DataFrame, keys: Sequence[str], grid: Sequence[float], regressor: Regressor, reducer: Linear | Origin, log: bool, rounds: int, short: int = SHORT) -> DataFrame:
    """keys, g, and fields of the reducer, for the g with the least sse: first of the grid, then ``rounds`` times of FINE values between the best one's neighbours.

    Spaced evenly in the logarithm or plainly. Of values whose squares are equal (TIE, EXACT) the first is taken, so where the data
    can't tell rates beyond some value apart, that value comes out: a lower bound.
    df (keys, what the regressor takes of each point, _y) is staged, as its keys' points are counted first: keys of more than ``short`` points
    are fitted by partial sums, all others in a row each.
    """
    df = df.filter(" and ".join(f"{k} is not null" for k in keys))
    how = (keys, grid, regressor, reducer, log, rounds)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    some, every, n = counts.agg(F.max("_n") > short, F.min("_n") > short, F.count_if(F.col("_n") > short)).first()
    if not some:
        return by_rows(df, *how)
    if every:
        return by_sums(df, *how)
    long = counts.filter(F.col("_n") > short).select(*keys)
    long = F.broadcast(long) if n <= BROADCAST else long
    both = by_rows(df.join(long, list(keys), "left_anti"), *how)
    return both.unionByName(by_sums(staged(df.join(long, list(keys), "left_semi"), "long"), *how))


def by_sums(d: DataFrame, keys: Sequence[str], grid: Sequence[float], regressor: Regressor, reducer: Linear | Origin, log: bool, rounds: int) -> DataFrame:
    """``bracketed`` by partial sums of each candidate."""
    tries = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for g, lo, hi in tries_of(grid)])
    at = lambda k: between(F, F.col("lo"), F.col("hi"), k, log)
    finer = F.array(*[F.struct(at(k).alias("g"), at(max(0, k - 1)).alias("lo"), at(min(FINE - 1, k + 1)).alias("hi")) for k in range(FINE)])
    others, found = [f for f in reducer.fields if f not in ("sse", "syy")], None
    for _ in range(rounds + 1):
        if found is None:
            tried = d.withColumn("_c", F.explode(tries))
        else:
            tried = d.join(found.select(*keys, finer.alias("_f")), list(keys)).withColumn("_c", F.explode("_f")).drop("_f")
        tried = tried.select(*d.columns, F.col("_c.g").alias("g"), F.col("_c.lo").alias("lo"), F.col("_c.hi").alias("hi")).withColumn("_x", regressor(F, F.col("g"), F.col))
        held = reducer.sums(tried, [*keys, "g", "lo", "hi"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("g", "lo", "hi", "sse", "syy", *others))).alias("_c"))
        held = held.withColumn("_least", F.array_min(F.transform("_c", lambda x: x["sse"])))
        first = F.get(F.filter("_c", lambda x: x["sse"] <= F.col("_least") * (1 + TIE) + EXACT * x["syy"]), F.lit(0))
        found = held.select(*keys, first.alias("_b")).filter("_b is not null").select(*keys, "_b.*")
    return found.select(*keys, "g", *reducer.fields)


def by_rows(d: DataFrame, keys: Sequence[str], grid: Sequence[float], regressor: Regressor, reducer: Linear | Origin, log: bool, rounds: int) -> DataFrame:
    """``bracketed`` of keys with few points: a row of points each, and every round over arrays of a batch of rows."""
    points = [c for c in d.columns if c not in keys]
    rows = d.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in points])).alias("_p"))
    schema = T.StructType([d.schema[k] for k in keys] + [T.StructField(f, T.DoubleType()) for f in ("g", *reducer.fields)])
    tries = tries_of(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("_p").offsets.to_numpy()[:-1]
            cuts = [0, *(np.flatnonzero(np.diff(starts // AT_ONCE)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    at, found = best_of_rows(batch.slice(a, b - a), keys, points, tries, regressor, reducer, log, rounds)
                    kept = [batch.column(k).slice(a, b - a).take(pa.array(at)) for k in keys]
                    yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=schema.names)

    return rows.select(*keys, "_p").mapInArrow(run, schema)


def best_of_rows(batch: pa.RecordBatch, keys: Sequence[str], points: Sequence[str], tries: Sequence[tuple], regressor: Regressor, reducer: Linear | Origin, log: bool, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a fit, and their g and fields; nulls, NaN and ties as in ``by_sums``."""
    packed = batch.column("_p")
    held = dict(zip(points, packed.flatten().flatten()))
    there = {c: v.is_valid().to_numpy(zero_copy_only=False) for c, v in held.items()}
    row = np.repeat(np.arange(batch.num_rows), np.diff(packed.offsets.to_numpy()))
    full = np.logical_and.reduce([there[c] for c in points if c != "_y"])
    count = lambda which: np.bincount(row[which], minlength=batch.num_rows)
    enough = (count(full) >= LEAST_POINTS) & (count(full & there["_y"]) > 0)
    kept = np.flatnonzero(full & enough[row] & (there["_y"] | (not reducer.whole)))
    rows = np.flatnonzero(enough)
    if not len(rows):
        return rows, np.empty((1 + len(reducer.fields), 0))
    value = {c: np.where(there[c], v.to_numpy(zero_copy_only=False), 0.0)[kept] for c, v in held.items()}
    value |= {c: batch.column(c).to_numpy(zero_copy_only=False)[row[kept]] for c in keys}
    sizes = np.bincount(row[kept], minlength=batch.num_rows)[rows]
    sse, syy, found = reducer.fields.index("sse") + 3, reducer.fields.index("syy") + 3, None
    with np.errstate(all="ignore"):
        fit = reducer.arrays(value["_y"], np.cumsum(sizes) - sizes, sizes)
        some = np.ones(len(rows), bool)
        for _ in range(rounds + 1):
            if found is None:
                brackets = [tuple(np.full(len(rows), x) for x in t) for t in tries]
            else:
                at = [between(np, found[1], found[2], k, log) for k in range(FINE)]
                brackets = [(at[k], at[max(0, k - 1)], at[min(FINE - 1, k + 1)]) for k in range(FINE)]
            tried = []
            for g, lo, hi in brackets:
                sxx, *fields = fit(regressor(np, np.repeat(g, sizes), value.__getitem__))
                tried.append((g, lo, hi, *fields, ~(sxx <= 0)))
            tried = np.array(tried, dtype=float)
            able = tried[:, -1] > 0
            bound = np.fmin.reduce(np.where(able, tried[:, sse], np.nan)) * (1 + TIE) + EXACT * tried[:, syy]
            hit = able & (np.isnan(bound) | (tried[:, sse] <= bound))
            some &= hit.any(axis=0)
            found = tried[hit.argmax(axis=0), :-1, np.arange(len(rows))].T
    return rows[some], np.delete(found, (1, 2), axis=0)[:, some]


def grid_fit(df: DataFrame, keys: Sequence[str], grid: Sequence[float], regressor: Regressor, rounds: int = ROUNDS, short: int = SHORT) -> DataFrame:
    """keys, g, b, c, sse, syy: _y = b + c * regressor(g), for the g with the least squares."""
    return bracketed(df, keys, grid, regressor, Linear(), True, rounds, short)


def origin_fit(df: DataFrame, keys: Sequence[str], grid: Sequence[float], regressor: Regressor, low: float, high: float, rounds: int = ROUNDS, short: int = SHORT) -> DataFrame:
    """keys, g, k, sse, syy: _y = k * regressor(g) with k clipped to [low, high]."""
    return bracketed(df, keys, grid, regressor, Origin(low, high), False, rounds, short)


def best_candidate(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str], lowest: bool = False) -> DataFrame:
    """Per key the columns of the row with the highest (or lowest) order."""
    pick = F.min_by if lowest else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct(*columns), order).alias("_b")).select(*keys, "_b.*")


def inverse_axis_r2(df: DataFrame, keys: Sequence[str], t: Column, back: Column) -> DataFrame:
    """keys, r2: how well the time axis is recovered from the fit."""
    d = df.withColumn("_t", t).withColumn("_e", (back - t) * (back - t))
    return d.groupBy(*keys).agg((1 - F.sum("_e") / F.nullif(F.regr_sxx("_t", "_t"), F.lit(0.0))).alias("r2"))


def prefix_moments(df: DataFrame, moments: dict[str, Column], keys: Sequence[str] = SEG, slice_points: int = SLICE) -> DataFrame:
    """Adds each moment summed over the key's points up to and with a row (order: pt).

    Running sums inside slices of pt, and a prefix over the slices' totals, so a long segment is many tasks.
    """
    d = df.withColumn("_s", F.floor(F.col("pt") / slice_points)).withColumns({f"_m_{m}": c.cast("double") for m, c in moments.items()})
    totals = d.groupBy(*keys, "_s").agg(*[F.sum(f"_m_{m}").alias(f"_t_{m}") for m in moments])
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_s", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0.0)).alias(f"_b_{m}") for m in moments])
    inside = running(*keys, "_s")
    d = d.select(*df.columns, "_s", *[F.sum(f"_m_{m}").over(inside).alias(f"_i_{m}") for m in moments]).join(totals, [*keys, "_s"])
    return d.select(*df.columns, *[(F.col(f"_b_{m}") + F.col(f"_i_{m}")).alias(m) for m in moments])


def leading_fits(df: DataFrame, layer: float = 0.0, slice_points: int = SLICE) -> DataFrame:
    """meas_id, seg_pos, n, m, b, c, r2 (null where there is no fit) of u = b + c * (sqrt(tau + layer) - sqrt(layer)) over each segment's first m points.

    r2 is that of the inverted axis: tau recovered from u is a square of u, so its squares come from moments of u and tau as well.
    """
    d = df.filter("t is not null and u is not null").select(*SEG, "pt", "t", "u")
    ends = d.groupBy(*SEG).agg(F.min("t").alias("_t0"), F.avg("u").alias("_mean"), F.count(F.lit(1)).alias("n"))
    d = d.join(ends, SEG).select(*SEG, "pt", "n", "_mean", (F.col("t") - F.col("_t0")).alias("_tau"), (F.col("u") - F.col("_mean")).alias("_v"))
    x, u, t, root = F.sqrt(F.col("_tau") + layer) - layer**0.5, F.col("_v"), F.col("_tau"), layer**0.5
    sums = {"m": F.lit(1), "sx": x, "sxx": x * x, "su": u, "sxu": x * u, "su2": u * u, "su3": u * u * u, "su4": u * u * u * u, "st": t, "st2": t * t, "stu": t * u, "stu2": t * u * u}
    d = prefix_moments(d, sums, SEG, slice_points)
    m = F.col("m")
    d = d.withColumn("_sxx", F.col("sxx") - F.col("sx") * F.col("sx") / m)
    slope = F.nullif(F.try_divide(F.col("sxu") - F.col("sx") * F.col("su") / m, F.when(m >= LEAST_POINTS, F.nullif("_sxx", F.lit(0.0)))), F.lit(0.0))
    d = d.withColumn("c", slope).withColumn("_b", (F.col("su") - F.col("c") * F.col("sx")) / m)
    # tau recovered: (p u + q)^2 - layer = a2 u^2 + a1 u + a0
    p, q = 1 / F.col("c"), root - F.col("_b") / F.col("c")
    d = d.withColumn("_a2", p * p).withColumn("_a1", 2 * p * q).withColumn("_a0", q * q - layer)
    a2, a1, a0 = F.col("_a2"), F.col("_a1"), F.col("_a0")
    off = F.col("st2") - 2 * (a2 * F.col("stu2") + a1 * F.col("stu") + a0 * F.col("st"))
    off = off + a2 * a2 * F.col("su4") + 2 * a2 * a1 * F.col("su3") + (a1 * a1 + 2 * a2 * a0) * F.col("su2") + 2 * a1 * a0 * F.col("su") + a0 * a0 * m
    r2 = 1 - off / F.nullif(F.col("st2") - F.col("st") * F.col("st") / m, F.lit(0.0))
    return d.select(*SEG, "n", m.cast("long").alias("m"), (F.col("_b") + F.col("_mean")).alias("b"), "c", r2.alias("r2"))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body's value for a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Levels of the bisection that are gone through at once: 2^LEVELS stretches of a segment are held in a row.
LEVELS = 12
NONE = "struct<m:bigint,r2:double,b:double,c:double>"


def bisected(fits: DataFrame, threshold: float, levels: int = LEVELS) -> DataFrame:
    """meas_id, seg_pos, n, m, b, c, r2: the leading stretch that halving finds.

    It begins with the first half. A bracket is [k n / 2^d, (k + 1) n / 2^d]; the stretch up to its first quarter or up to its third is next, whichever
    has the higher r2, and the half it lies in the next bracket. The first that reaches the threshold is taken; when the bracket is one point wide, the best seen.
    The stretches that ``levels`` halvings can meet are gathered in an array (at most 2^levels of a segment); longer segments go on from there.
    """
    state, out = None, None
    longest = fits.agg(F.max("n")).first()[0] or 0
    if longest > 1 << levels:
        fits = staged(fits, "stretches")
    point = F.struct("m", "r2", "b", "c")
    rank = lambda p: F.coalesce(p["r2"], F.lit(-1e300))
    place = lambda j, at: F.call_function("div", j * F.col("n"), F.call_function("shiftleft", F.lit(1).cast("long"), at))
    while True:
        d = fits.withColumn("d", F.lit(0)).withColumn("k", F.lit(0).cast("long")).withColumn("best", F.lit(None).cast(NONE)) if state is None else fits.join(state, [*SEG, "n"])
        full = F.ceil(F.log2("n")).cast("int") + 2  # K n / 2^full is any whole place
        d = d.withColumn("e", F.least(full, F.col("d") + levels))
        lo, hi = place(F.col("k"), F.col("d")), place(F.col("k") + 1, F.col("d"))
        # the least K whose place isn't below m, and whether m is a place at all
        least = F.ceil(F.col("m") * F.pow(F.lit(2.0), F.col("e")) / F.col("n")).cast("long")
        d = d.filter((F.col("m") >= lo) & (F.col("m") <= hi) & (place(least, F.col("e")) == F.col("m")))
        d = d.groupBy(*SEG, "n", "d", "k", "e", "best").agg(F.map_from_entries(F.collect_list(F.struct("m", point.alias("p")))).alias("at"))

        def step(s: Column, _: Column) -> Column:
            small = place(s["k"] + 1, s["d"]) - place(s["k"], s["d"]) <= 1
            of = lambda j: F.try_element_at("at", place(4 * s["k"] + j, s["d"] + 2))

            def chosen(x: Column) -> Column:
                return F.when(rank(x["left"]) > rank(x["right"]), F.struct(F.lit(0).alias("half"), x["left"].alias("p"))).otherwise(F.struct(F.lit(1).alias("half"), x["right"].alias("p")))

            def moved(x: Column) -> Column:
                reached = rank(x["p"]) >= threshold
                best = F.when(reached | (rank(x["p"]) > rank(s["best"])), x["p"]).otherwise(s["best"])
                return F.struct((s["d"] + 1).alias("d"), (2 * s["k"] + x["half"]).alias("k"), best.alias("best"), reached.alias("done"))

            stay = F.struct(s["d"].alias("d"), s["k"].alias("k"), s["best"].alias("best"), (s["done"] | small).alias("done"))
            return F.when(s["done"] | small | (s["d"] + 2 > F.col("e")), stay).otherwise(_with(_with(F.struct(of(1).alias("left"), of(3).alias("right")), chosen), moved))

        half = F.try_element_at("at", place(F.lit(1), F.lit(1)))
        begun = F.when(F.col("d") > 0, F.col("best")).otherwise(half)
        start = F.struct("d", "k", begun.alias("best"), (F.coalesce(begun["r2"], F.lit(-1e300)) >= threshold).alias("done"))
        d = d.withColumn("s", F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step)).select(*SEG, "n", "s.*")
        if longest <= 1 << levels:
            return d.filter("best.r2 is not null").select(*SEG, "n", "best.*")
        d = staged(d, "bisected")
        ended = d.filter("done and best.r2 is not null").select(*SEG, "n", "best.*")
        out = ended if out is None else out.unionByName(ended)
        state = d.filter("not done").drop("done")
        if state.isEmpty():
            return out


def fit_sqrt(df: DataFrame, threshold: float = 0.95, layer: float = 0.0, slice_points: int = SLICE, levels: int = LEVELS) -> DataFrame:
    """meas_id, seg_pos, share, b, c, r2: u = b + c * (sqrt(tau + layer) - sqrt(layer)) over a leading share of each segment, found by halving (``bisected``)."""
    found = bisected(leading_fits(df, layer, slice_points), threshold, levels)
    return found.select(*SEG, (F.col("m") / F.col("n")).alias("share"), "b", "c", "r2")


#: Rates of an exponential decay, in units of one over the segment's duration.
RATES = tuple(0.2 * 250 ** (k / 23) for k in range(24))


def fit_exp_decay(df: DataFrame, rates: Sequence[float] = RATES, y: str = "u", rounds: int = ROUNDS) -> DataFrame:
    """meas_id, seg_pos, asymptote, amplitude, rate, sse: y = asymptote + amplitude * exp(-rate * tau).

    The rate is first of ``rates`` (over the duration), then narrowed (``bracketed``) to about 2e-4 of itself.
    """
    return decays(decay_points(df, y), y, rates, rounds)


def decay_points(df: DataFrame, *ys: str) -> DataFrame:
    """What ``decays`` takes of the points, staged: one pass over df for all values that are fitted."""
    return staged(since_start(df).filter("span > 0").select(*SEG, "tau", "span", *ys), "decays")


def decays(points: DataFrame, y: str = "u", rates: Sequence[float] = RATES, rounds: int = ROUNDS) -> DataFrame:
    """``fit_exp_decay`` of ``decay_points``."""
    d = points.select(*SEG, "tau", "span", F.col(y).alias("_y"))
    fit = grid_fit(d, [*SEG, "span"], rates, lambda m, g, c: m.exp(-g * c("tau") / c("span")), rounds)
    return fit.select(*SEG, F.col("b").alias("asymptote"), F.col("c").alias("amplitude"), (F.col("g") / F.col("span")).alias("rate"), "sse")


#: Trailing shares of a segment that a decay's fit tries; what the argument of a logarithm is at least.
TAILS, LEAST_RATIO = (1.0, 0.75, 0.5, 0.25), 1e-3


def fit_exp_decays(df: DataFrame, threshold: float = 0.95, passes: int = 2, rates: Sequence[float] = RATES, y: str = "u", rounds: int = ROUNDS) -> DataFrame:
    """meas_id, seg_pos, pass, share, asymptote, amplitude, rate, r2: y = asymptote + amplitude * exp(-rate * tau) over a trailing share of each segment.

    The longest share whose inverted axis reaches the threshold, else the one with the best r2. Each further pass fits the faster decay: the residual
    of the stretch before the last one's, where at least LEAST_POINTS are left. tau counts from the segment's start in each pass. Rates as in ``fit_exp_decay``.
    """
    starts = df.groupBy(*SEG).agg(F.min("t").alias("_t0"))
    rest, out = df.join(starts, SEG).select(*SEG, "pt", F.col(y).alias("_v"), (F.col("t") - F.col("_t0")).alias("_tau")), None
    for k in range(passes):
        d = staged(numbered(staged(rest, "rest"), SEG, "_k", "_n"), "numbered")
        tail = lambda share: F.col("_k") > F.col("_n") - F.ceil(share * F.col("_n"))
        ends = d.groupBy(*SEG).agg(F.max("_tau").alias("_t1"), *[F.min(F.when(tail(F.lit(x)), F.col("_tau"))).alias(f"_t{j}_") for j, x in enumerate(TAILS)])
        tails = F.array(*[F.struct(F.lit(x).alias("share"), F.col(f"_t{j}_").alias("t0"), (F.col("_t1") - F.col(f"_t{j}_")).alias("span")) for j, x in enumerate(TAILS)])
        d = staged(d.join(ends.select(*SEG, tails.alias("_tails")), SEG), "tails")
        own = F.explode(F.filter("_tails", lambda x: (x["span"] > 0) & tail(x["share"])))
        parts = d.select(*SEG, "_v", "_tau", own.alias("_w")).select(*SEG, F.col("_v").alias("_y"), "_tau", "_w.share", F.col("_w.t0").alias("_t0"), F.col("_w.span").alias("_span"))
        fit = grid_fit(parts, [*SEG, "share", "_t0", "_span"], rates, lambda m, g, c: m.exp(-g * (c("_tau") - c("_t0")) / c("_span")), rounds)
        fit = fit.filter("c <> 0").select(*SEG, "share", "_t0", F.col("b").alias("asymptote"), (F.col("c") * F.exp(F.col("g") * F.col("_t0") / F.col("_span"))).alias("amplitude"), (F.col("g") / F.col("_span")).alias("rate"))
        # a segment's fits are one row, so that its points meet them once, not once a share
        fits = fit.groupBy(*SEG).agg(F.collect_list(F.struct("share", "_t0", "asymptote", "amplitude", "rate")).alias("_f"))
        both = d.join(fits, SEG).select(*SEG, "_v", "_tau", F.explode(F.filter("_f", lambda x: tail(x["share"]))).alias("_f")).select(*SEG, "_v", "_tau", "_f.*")
        back = -F.ln(F.greatest((F.col("_v") - F.col("asymptote")) / F.col("amplitude"), F.lit(LEAST_RATIO))) / F.col("rate")
        r2 = inverse_axis_r2(both, [*SEG, "share", "_t0", "asymptote", "amplitude", "rate"], F.col("_tau"), back)
        order = F.struct((F.coalesce("r2", F.lit(-1e300)) >= threshold).alias("ok"), F.when(F.col("r2") >= threshold, F.col("share")).otherwise(F.col("r2")).alias("v"), "share")
        found = best_candidate(r2.filter("r2 is not null"), SEG, order, ["share", "_t0", "asymptote", "amplitude", "rate", "r2"])
        found = staged(found.withColumn("pass", F.lit(k)), "decays")
        out = found if out is None else out.unionByName(found)
        value = F.col("_v") - F.col("asymptote") - F.col("amplitude") * F.exp(-F.col("rate") * F.col("_tau"))
        rest = d.join(found.drop("pass"), SEG).filter("_tau < _t0").select(*SEG, "pt", value.alias("_v"), "_tau")
    return out.select(*SEG, "pass", "share", "asymptote", "amplitude", "rate", "r2")


def fit_power_law(df: DataFrame, exponents: Sequence[float], high: float, rounds: int = ROUNDS) -> DataFrame:
    """meas_id, seg_pos, exponent, k, ln_k, explained: u - u0 = k * tau^n with 0 <= k <= high, and n of ``exponents``, then narrowed (``bracketed``)."""
    first = df.groupBy(*SEG).agg(F.min_by("u", "pt").alias("_u0"))
    d = staged(since_start(df).join(first, SEG).filter("tau > 0").select(*SEG, "tau", (F.col("u") - F.col("_u0")).alias("_y")), "powers")
    fit = origin_fit(d, SEG, exponents, lambda m, g, c: m.power(c("tau"), g), 0.0, high, rounds)
    return fit.select(*SEG, F.col("g").alias("exponent"), "k", F.when(F.col("k") > 0, F.ln("k")).alias("ln_k"), (1 - F.col("sse") / F.nullif(F.col("syy"), F.lit(0.0))).alias("explained"))


def fit_butler_volmer(df: DataFrame, keys: Sequence[str], s: Column, y: Column, alphas: Sequence[float], rounds: int = ROUNDS) -> DataFrame:
    """keys, alpha, scale: y = scale * sqrt(1000) * s^(1 - alpha) * (1 - s)^alpha, alpha of ``alphas``, then narrowed (``bracketed``)."""
    d = staged(df.select(*keys, s.alias("_s"), y.alias("_y")).filter((F.col("_s") > 0) & (F.col("_s") < 1)), "kinetics")
    fit = origin_fit(d, keys, alphas, lambda m, g, c: 1000**0.5 * m.power(c("_s"), 1 - g) * m.power(1 - c("_s"), g), -1e300, 1e300, rounds)
    return fit.select(*keys, F.col("g").alias("alpha"), F.col("k").alias("scale"), "sse")


def fit_curve_values(df: DataFrame, fits: DataFrame) -> DataFrame:
    """Measured and fitted value of every point of the segments that have an exponential fit."""
    joined = since_start(df).join(fits, SEG)
    return joined.withColumn("fitted", F.col("asymptote") + F.col("amplitude") * F.exp(-F.col("rate") * F.col("tau")))


def static_features(df: DataFrame) -> DataFrame:
    """Per segment: asymptotic voltage (of the fit, else the last), IR step, and the decays of voltage and current."""
    ends = ir_step(segment_ends(df))
    points = decay_points(df, "u", "i")
    current = decays(points, "i").select(*SEG, F.col("asymptote").alias("i_asymptote"), F.col("amplitude").alias("i_amplitude"), F.col("rate").alias("i_rate"))
    both = ends.join(decays(points), SEG, "left").join(current, SEG, "left")
    return both.select(*SEG, F.coalesce("asymptote", "u1").alias("asymptotic_voltage"), "ir_step", "amplitude", "rate", "i_asymptote", "i_amplitude", "i_rate")


def gitt_features(df: DataFrame, wanted: Sequence[int] | None = None, exp_window: tuple[float | None, float | None] | None = None, sqrt_window: tuple[float | None, float | None] | None = None) -> DataFrame:
    """meas_id, seg_pos, feature (5 * segment + k), value: asymptote minus U0, amplitude, 1 / rate, U0, 1 / slope of each segment.

    The windows (seconds from each segment's start) cut what the decay and the square root are fitted to.
    """
    cut = lambda window: df if window is None else keep_window(df, *window)
    both = fit_exp_decay(cut(exp_window)).join(fit_sqrt(cut(sqrt_window)), SEG)
    values = [F.col("asymptote") - F.col("b"), F.col("amplitude"), 1 / F.col("rate"), F.col("b"), 1 / F.col("c")]
    long = both.select(*SEG, F.posexplode(F.array(*values)).alias("k", "value")).withColumn("feature", 5 * F.col("seg_pos") + F.col("k"))
    if wanted is not None:
        long = long.filter(F.col("feature").isin(list(wanted)))
    return long.select(*SEG, "feature", "value")


def extract_ocv(df: DataFrame, rests: Column, head: float, start: Column | float = 0.0, sign: float = 1.0, capacity: float = 1.0) -> DataFrame:
    """meas_id, seg_pos, soc, ocv, direction of the segments for which ``rests`` holds: SOC at their end, asymptote of their decay, and the way of the pulse before.

    The first ``head`` seconds of a rest are left out of its fit; a rest without a fit or without a pulse before it has no row.
    """
    soc = coulomb_count(df, start, sign, capacity).groupBy(*SEG).agg(F.max_by("soc", "pt").alias("soc"))
    pulses = pair_pulse_rest(segment_ends(df), ["i_mean"])
    d = fit_exp_decay(trim_head(df.filter(rests), head)).join(soc, SEG).join(pulses, SEG)
    return d.select(*SEG, "soc", F.col("asymptote").alias("ocv"), F.when(F.col("pulse_i_mean") >= 0, "lithiation").otherwise("delithiation").alias("direction"))
