"""Segment algebra over long tables of points.

Key columns: ``meas_id``, ``seg_pos`` (dense position of the segment), ``pt`` (order). Every window is partitioned by
measurement, or by measurement and segment where the operator allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltlake.operators.storage import staged

MEAS = ["meas_id"]
SEG = ["meas_id", "seg_pos"]


def within(*keys: str, order: Sequence[str] = ("pt",)):
    return Window.partitionBy(*keys).orderBy(*order)


def whole(*keys: str, order: Sequence[str] = ("pt",)):
    return within(*keys, order=order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def running(*keys: str, order: Sequence[str] = ("pt",)):
    return within(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def state_sign(df: DataFrame, signs: dict[str, float], state: str, current: str) -> DataFrame:
    """Multiplies the current by the factor of its row's state; an unmapped state fails the job with its name."""
    factor = F.create_map(*[F.lit(x) for pair in signs.items() for x in pair])[F.col(state)]
    known = F.when(factor.isNotNull(), factor).otherwise(F.raise_error(F.concat(F.lit("no sign for state "), F.coalesce(F.col(state), F.lit("null")))).cast("int"))
    return df.withColumn(current, known * F.col(current))


def flip_sign(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: -F.col(c) for c in columns})


#: Points of a measurement that one task numbers at a time.
SLICE = 1 << 16


def segment_by_change(df: DataFrame, column: str, slice_points: int = SLICE) -> DataFrame:
    """seg_pos: counts the changes of ``column`` along each measurement, from 0.

    In two levels: changes inside slices of ``pt``, then a prefix over the slices' totals, with a change where a slice begins
    with another value than the last one ended with. So a long measurement isn't one task.
    """
    d = df.withColumn("_s", F.floor(F.col("pt") / slice_points))
    w = within("meas_id", "_s")
    inside = F.when(F.row_number().over(w) == 1, 0).when(F.lag(column).over(w).eqNullSafe(F.col(column)), 0).otherwise(1)
    d = d.withColumn("_c", inside).withColumn("_in", F.sum("_c").over(running("meas_id", "_s")))
    ends = d.groupBy("meas_id", "_s").agg(F.sum("_c").alias("_n"), F.min_by(F.struct(F.col(column).alias("v")), "pt").alias("_first"), F.max_by(F.struct(F.col(column).alias("v")), "pt").alias("_last"))
    order = Window.partitionBy("meas_id").orderBy("_s")
    new = F.when(F.lag("_last").over(order).isNull() | F.lag("_last.v").over(order).eqNullSafe(F.col("_first.v")), 0).otherwise(1)
    ends = ends.withColumn("_new", new)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.select("meas_id", "_s", before.alias("_before"))
    return d.join(ends, ["meas_id", "_s"]).withColumn("seg_pos", (F.col("_before") + F.col("_in")).cast("int")).drop("_c", "_s", "_in", "_before")


def numbered(df: DataFrame, keys: Sequence[str], number: str, count: str | None = None, slice_points: int = SLICE) -> DataFrame:
    """Adds each row's number in its key's order of pt, from 1, and the key's rows: numbers inside slices of pt, and a prefix over the slices."""
    d = df.withColumn("_s", F.floor(F.col("pt") / slice_points))
    d = d.withColumn("_in", F.row_number().over(within(*keys, "_s")))
    slices = d.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0))).withColumn("_all", F.sum("_c").over(Window.partitionBy(*keys))).drop("_c")
    d = d.join(slices, [*keys, "_s"]).withColumn(number, F.col("_before") + F.col("_in"))
    return (d.withColumn(count, F.col("_all")) if count else d).drop("_s", "_in", "_before", "_all")


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str, staging: str = "ordered") -> DataFrame:
    """Adds each row's number in its key by any order, from 1: ranges of (key, order) are sorted apart, and a prefix runs over the ranges."""
    d = staged(df.repartitionByRange(*keys, *order).withColumn("_s", F.spark_partition_id()), staging)
    slices = d.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(*keys, "_s", F.coalesce(before, F.lit(0)).alias("_before"))
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order)))
    return d.join(slices, [*keys, "_s"]).withColumn(number, F.col("_before") + F.col("_in")).drop("_s", "_in", "_before")


def with_halo(df: DataFrame, number: str, before: int, after: int, slice_rows: int = SLICE) -> DataFrame:
    """Adds _s, the slice of a row by its number, and _halo: the last ``before`` and first ``after`` rows of a slice are in its neighbours as well.

    So windows by (key, _s) see a row's neighbours, and a long key is many tasks. Rows with _halo are to be dropped after.
    """
    if max(before, after) > slice_rows:
        raise ValueError("a slice must hold its neighbours' rows")
    at, s = (F.col(number) - 1) % slice_rows, F.floor((F.col(number) - 1) / slice_rows)
    own = F.struct(s.alias("s"), F.lit(False).alias("halo"))
    up = F.when(at >= slice_rows - before, F.struct((s + 1).alias("s"), F.lit(True).alias("halo")))
    down = F.when((at < after) & (s > 0), F.struct((s - 1).alias("s"), F.lit(True).alias("halo")))
    return df.withColumn("_w", F.explode(F.array_compact(F.array(own, up, down)))).withColumn("_s", F.col("_w.s")).withColumn("_halo", F.col("_w.halo")).drop("_w")


def seg_filter(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Keeps whole segments."""
    return df.filter(F.col("seg_pos").isin(list(positions)))


def seg_reindex(df: DataFrame) -> DataFrame:
    """Numbers each measurement's segments 0, 1, ... without gaps."""
    return df.withColumn("seg_pos", (F.dense_rank().over(Window.partitionBy("meas_id").orderBy("seg_pos")) - 1).cast("int"))


def seg_slice(df: DataFrame, ranges: Sequence[tuple[int | None, int | None, int]]) -> DataFrame:
    """Slices start:stop:step of each measurement's segments, concatenated in order; repeats stay. Negative bounds count from the end."""
    spark = df.sparkSession
    table = spark.createDataFrame([(k, a, b, s) for k, (a, b, s) in enumerate(ranges)], "r int, a int, b int, s int")
    n = (F.max("seg_pos").over(Window.partitionBy("meas_id")) + 1).alias("_n")
    joined = df.select("*", n).join(F.broadcast(table))
    at = lambda c, default: F.coalesce(F.when(F.col(c) < 0, F.greatest(F.lit(0), F.col("_n") + F.col(c))).otherwise(F.col(c)), default)
    start, stop = at("a", F.lit(0)), at("b", F.col("_n"))
    kept = joined.filter((F.col("seg_pos") >= start) & (F.col("seg_pos") < stop) & ((F.col("seg_pos") - start) % F.col("s") == 0))
    new = F.dense_rank().over(Window.partitionBy("meas_id").orderBy("r", "seg_pos")) - 1
    return kept.withColumn("new_pos", new.cast("int")).drop("_n", "r", "a", "b", "s")


def seg_gather(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """The listed segments in the listed order, repeats included: new_pos is the place in the list."""
    wanted = df.sparkSession.createDataFrame([(k, p) for k, p in enumerate(positions)], "new_pos int, seg_pos int")
    return df.join(F.broadcast(wanted), "seg_pos")


def time_rebase(df: DataFrame, keys: Sequence[str] = MEAS) -> DataFrame:
    first = df.groupBy(*keys).agg(F.min("t").alias("_t0"))
    return df.join(first, list(keys)).withColumn("t", F.col("t") - F.col("_t0")).select(*df.columns)


def nearest_crossing(df: DataFrame, keys: Sequence[str], x: Column, value: Column, slice_rows: int = SLICE) -> DataFrame:
    """keys, pos: the first position at which x crosses the value, at the nearer neighbour; without one the nearer end."""
    d = with_halo(numbered(df.select(*keys, "pt", (x - value).alias("r")), keys, "_k", slice_points=slice_rows), "_k", 0, 1, slice_rows)
    w = within(*keys, "_s", order=("_k",))
    d = d.withColumn("after", F.lead("r").over(w)).withColumn("after_pt", F.lead("pt").over(w)).filter("not _halo")
    place = F.when(F.signum("r") != F.signum("after"), F.when(F.abs("r") < F.abs("after"), F.col("pt")).otherwise(F.col("after_pt")))
    ends = F.when(F.abs(F.min_by("r", "pt")) < F.abs(F.max_by("r", "pt")), F.min("pt")).otherwise(F.max("pt"))
    return d.withColumn("place", place).groupBy(*keys).agg(F.coalesce(F.min("place"), ends).alias("pos"))


def trim_head(df: DataFrame, seconds: float) -> DataFrame:
    """Drops the first ``seconds`` of each segment, from the point nearest to that time on."""
    based = df.withColumn("_t", F.col("t") - F.first("t").over(whole(*SEG)))
    at = nearest_crossing(based, SEG, F.col("_t"), F.lit(seconds))
    return based.join(at, SEG).filter(F.col("pt") >= F.col("pos")).drop("_t", "pos")


def keep_window(df: DataFrame, start: float | None, stop: float | None, last: float | None = None) -> DataFrame:
    """Keeps t0 + start <= t <= t0 + stop of each segment, or its last ``last`` seconds."""
    w = whole(*SEG)
    d = df.withColumn("_a", F.first("t").over(w)).withColumn("_b", F.last("t").over(w))
    if last is not None:
        d = d.filter(F.col("t") >= F.col("_b") - last)
    else:
        d = d.filter((F.col("t") >= F.col("_a") + (start or 0.0)) & (F.col("t") <= F.col("_a") + stop if stop is not None else F.lit(True)))
    return d.drop("_a", "_b")


def monotone_cleanup(df: DataFrame, keys: Sequence[str], x: str, slice_rows: int = SLICE) -> DataFrame:
    """Keeps the running records of x in the direction that most steps have; adds ``ord``, ascending in x. Equal x stay if no step goes against the direction.

    Records run inside slices, over the extremes of the slices before.
    """
    d = with_halo(numbered(df, keys, "_k", slice_points=slice_rows), "_k", 1, 0, slice_rows)
    w = within(*keys, "_s", order=("_k",))
    d = d.withColumn("_d", F.signum(F.col(x) - F.lag(x).over(w))).filter("not _halo")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_hi", F.max(x).over(before)).withColumn("_lo", F.min(x).over(before))
    slices = d.groupBy(*keys, "_s").agg(F.max(x).alias("_h"), F.min(x).alias("_l"), F.count_if(F.col("_d") > 0).alias("_u"), F.count_if(F.col("_d") < 0).alias("_f"))
    ahead, all_ = within(*keys, order=("_s",)).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    slices = slices.select(*keys, "_s", F.max("_h").over(ahead).alias("_h"), F.min("_l").over(ahead).alias("_l"), F.sum("_u").over(all_).alias("_up"), F.sum("_f").over(all_).alias("_down"))
    d = d.join(slices, [*keys, "_s"]).withColumn("_hi", F.greatest("_hi", "_h")).withColumn("_lo", F.least("_lo", "_l"))
    rising = F.col("_up") >= F.col("_down")
    record = F.when(rising, (F.col("_down") == 0) | F.col("_hi").isNull() | (F.col(x) > F.col("_hi"))).otherwise((F.col("_up") == 0) | F.col("_lo").isNull() | (F.col(x) < F.col("_lo")))
    kept = numbered(d.filter(record).withColumn("_rising", rising).select(*df.columns, "_rising"), keys, "_k", "_n", slice_rows)
    return kept.withColumn("ord", F.when(F.col("_rising"), F.col("_k") - 1).otherwise(F.col("_n") - F.col("_k")).cast("int")).drop("_rising", "_k", "_n")


def interval_bucket(df: DataFrame, cuts: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Names slices [start, stop) of each series by position; points in none are dropped."""
    name = F.lit(None).cast("string")
    for label, start, stop in reversed(cuts):
        name = F.when((F.col("pt") >= start) & (F.col("pt") < stop), label).otherwise(name)
    return df.withColumn("bucket", name).filter(F.col("bucket").isNotNull())


def freq_window(df: DataFrame, low: float, high: float, every: int) -> DataFrame:
    """Clips each spectrum to its points nearest to the frequency limits and keeps every ``every``-th of them."""
    a = nearest_crossing(df, MEAS, F.col("f"), F.lit(low)).withColumnRenamed("pos", "_a")
    b = nearest_crossing(df, MEAS, F.col("f"), F.lit(high)).withColumnRenamed("pos", "_b")
    d = df.join(a, MEAS).join(b, MEAS).filter((F.col("pt") >= F.least("_a", "_b")) & (F.col("pt") <= F.greatest("_a", "_b")))
    return d.filter((F.col("pt") - F.least("_a", "_b")) % every == 0).drop("_a", "_b")


def capacitive_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("im") < 0)


def null_nonpositive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in columns})


def column_presence(df: DataFrame) -> DataFrame:
    """name, present: for each column whether any value isn't null."""
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in df.columns])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("present")) for c in df.columns])).alias("x")).select("x.*")


def nest_points(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per segment; each column becomes the array of its values in point order."""
    rows = F.array_sort(F.collect_list(F.struct("pt", *columns)))
    nested = df.groupBy(*keys).agg(rows.alias("_r"))
    field = lambda c: F.transform("_r", lambda s: s[c])
    return nested.select(*keys, *[field(c).alias(c) for c in columns])


def explode_points(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The inverse: one row per point, pt from 0."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("pt", "_s")).select(*keys, "pt", *[F.col("_s")[c].alias(c) for c in columns])


def segment_merge(df: DataFrame, label: Column, unmatched: int = -1) -> DataFrame:
    """Merges neighbouring segments whose first points have equal group labels; no rule matched means ``unmatched``, which merges too.

    Adds ``group`` and ``merged_pos``; the merged segment keeps the label of its first member.
    """
    first = df.withColumn("_rn", F.row_number().over(within(*SEG))).filter("_rn = 1").select(*SEG, F.coalesce(label, F.lit(unmatched)).alias("group"))
    w = Window.partitionBy("meas_id").orderBy("seg_pos")
    new = F.when(F.lag("group").over(w) == F.col("group"), 0).otherwise(1)
    first = first.withColumn("_n", new).withColumn("merged_pos", (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return df.join(first.drop("_n"), SEG)


def segment_renumber(segs: DataFrame) -> DataFrame:
    """Closes the gaps that merging leaves in numeric labels: label minus the segments swallowed before. ``segs``: meas_id, merged_pos, first_label, members."""
    w = Window.partitionBy("meas_id").orderBy("merged_pos").rowsBetween(Window.unboundedPreceding, -1)
    return segs.withColumn("label", F.col("first_label") - F.coalesce(F.sum(F.col("members") - 1).over(w), F.lit(0)))


def coulomb_count(df: DataFrame, start: Column | float = 0.0, sign: float = 1.0, capacity: float = 1.0) -> DataFrame:
    """Adds ``soc``: start + sign / capacity * integral of the current by trapezoids; gaps between segments add nothing.

    In two levels, as segments are independent: running sums inside segments, and a prefix over the few segment totals.
    """
    w = within(*SEG)
    area = 0.5 * (F.lag("i").over(w) + F.col("i")) * (F.col("t") - F.lag("t").over(w))
    d = df.withColumn("_q", F.coalesce(area, F.lit(0.0))).withColumn("_in", F.sum("_q").over(running(*SEG)))
    totals = d.groupBy(*SEG).agg(F.sum("_q").alias("_total"))
    before = Window.partitionBy("meas_id").orderBy("seg_pos").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*SEG, F.coalesce(F.sum("_total").over(before), F.lit(0.0)).alias("_before"))
    begin = start if isinstance(start, Column) else F.lit(start)
    return d.join(totals, SEG).withColumn("soc", begin + (F.col("_before") + F.col("_in")) * (sign / capacity)).drop("_q", "_in", "_before")


def unit_interval(x: Column, keys: Sequence[str]) -> Column:
    w = whole(*keys)
    return (x - F.first(x).over(w)) / (F.last(x).over(w) - F.first(x).over(w))


def soc_assign(df: DataFrame, x: str, start: float, end: float, complement: bool = False, slice_keys: Sequence[str] = SEG) -> DataFrame:
    """Adds ``electrode_soc``: a fitted SOC range laid over each segment's axis in reverse order, or 1 less it."""
    ends = df.groupBy(*slice_keys).agg(F.min_by(x, "pt").alias("_a"), F.max_by(x, "pt").alias("_b"))
    soc = start + (1 - (F.col(x) - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))) * (end - start)
    return df.join(ends, list(slice_keys)).withColumn("electrode_soc", 1 - soc if complement else soc).drop("_a", "_b")


def segment_ends(df: DataFrame) -> DataFrame:
    """One row per segment: first and last time and voltage, mean current and number of points."""
    first, last = (lambda c: F.min_by(c, "pt")), (lambda c: F.max_by(c, "pt"))
    return df.groupBy(*SEG).agg(first("t").alias("t0"), last("t").alias("t1"), first("u").alias("u0"), last("u").alias("u1"), F.avg("i").alias("i_mean"), F.avg(F.abs("i")).alias("i_abs"), F.count(F.lit(1)).alias("n"))


def ir_step(ends: DataFrame) -> DataFrame:
    """First voltage minus the last of the segment before; 0 for the first segment."""
    w = Window.partitionBy("meas_id").orderBy("seg_pos")
    return ends.withColumn("ir_step", F.coalesce(F.col("u0") - F.lag("u1").over(w), F.lit(0.0)))


def delta_static(segs: DataFrame, column: str) -> DataFrame:
    w = Window.partitionBy("meas_id").orderBy("seg_pos")
    return segs.withColumn("delta", F.lead(column).over(w) - F.col(column))


def noise_estimate(df: DataFrame, keys: Sequence[str], x: str, slice_rows: int = SLICE) -> DataFrame:
    """Adds ``noise``: |x - mean of neighbours| * sqrt(pi / 2); ends take their neighbour's."""
    d = with_halo(numbered(df, keys, "_k", "_count", slice_rows), "_k", 2, 2, slice_rows)
    w = within(*keys, "_s", order=("_k",))
    inner = F.abs(F.col(x) - 0.5 * (F.lag(x).over(w) + F.lead(x).over(w))) * 1.2533141373155001
    d = d.withColumn("_n", inner)
    d = d.withColumn("noise", F.when(F.col("_k") == 1, F.lead("_n").over(w)).when(F.col("_k") == F.col("_count"), F.lag("_n").over(w)).otherwise(F.col("_n")))
    return d.filter("not _halo").drop("_n", "_k", "_count", "_s", "_halo")
