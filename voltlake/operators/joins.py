"""Joins of measurements: by source index, by ordinal, nearest, interpolating, and of parameter tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltlake.operators.storage import staged


def join_source_index(segs: DataFrame, ocv: DataFrame, value: str, index: Column | None = None) -> DataFrame:
    """The OCV row whose source index is the segment's label before (or the given one); the first if several. A segment without one fails the job."""
    wanted = index if index is not None else F.min("seg_pos").over(Window.partitionBy("meas_id")) - 1
    first = ocv.groupBy("meas_id", "source_index").agg(F.min_by(value, "pos").alias("start"))
    joined = segs.withColumn("source_index", wanted).join(first, ["meas_id", "source_index"], "left")
    return joined.withColumn("start", F.coalesce("start", F.raise_error(F.lit("no OCV row for a segment")).cast("double")))


def initial_concentration(segs: DataFrame, ocv: DataFrame, soc: str, largest: float) -> DataFrame:
    """Adds ``concentration``: the SOC at each segment's source index times the electrode's largest concentration."""
    return join_source_index(segs, ocv, soc).withColumn("concentration", F.col("start") * largest)


def pair_pulse_rest(segs: DataFrame, columns: Sequence[str], first_rest: int = 1) -> DataFrame:
    """Each rest (every second segment from ``first_rest``) with the named columns of the pulse before it."""
    w = Window.partitionBy("meas_id").orderBy("seg_pos")
    d = segs.withColumns({f"pulse_{c}": F.lag(c).over(w) for c in columns})
    return d.filter((F.col("seg_pos") >= first_rest) & ((F.col("seg_pos") - first_rest) % 2 == 0))


def align_cycles(*lists: tuple[str, DataFrame]) -> DataFrame:
    """Lists of (meas_id, seg_pos, value), each numbered by its own order, joined on that number: meas_id, cycle, <name>..."""
    out = None
    for name, df in lists:
        numbered = df.select("meas_id", (F.row_number().over(Window.partitionBy("meas_id").orderBy("seg_pos")) - 1).alias("cycle"), F.col("value").alias(name))
        out = numbered if out is None else out.join(numbered, ["meas_id", "cycle"])
    return out


def lookup_nearest(df: DataFrame, keys: Sequence[str], x: str, value: float | Column, columns: Sequence[str]) -> DataFrame:
    """Per key the columns of the row whose x is nearest to the value; the first of equally near ones."""
    target = value if isinstance(value, Column) else F.lit(value)
    best = F.min_by(F.struct(*columns), F.struct(F.abs(F.col(x) - target), "pt"))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def join_interp(queries: DataFrame, knots: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Adds y to each query row: linear between the knots around its x, null outside.

    Queries and knots are sorted together in ranges of (key, x), so a range join isn't needed, the cost stays linear and a long key is many
    tasks; the last knot before a range and the first behind it are carried over the ranges of the key.
    """
    # of knots with one x, the first and last values serve the two sides
    flat = knots.groupBy(*keys, x).agg(F.min(y).alias("_y"))
    names = queries.columns
    both = queries.withColumn("_y", F.lit(None).cast("double")).withColumn("_q", F.lit(True)).unionByName(flat.withColumn("_q", F.lit(False)), allowMissingColumns=True)
    both = staged(both.repartitionByRange(*keys, x).withColumn("_s", F.spark_partition_id()), "knots")
    knot = F.when(~F.col("_q"), F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    order = Window.partitionBy(*keys, "_s").orderBy(x, "_q")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    # a query at a knot's x sorts behind it, so the knot before is the knot itself
    d = both.withColumn("_k", knot).withColumn("_a", F.last("_k", True).over(back)).withColumn("_b", F.first("_k", True).over(ahead))
    ranges = both.withColumn("_k", knot).groupBy(*keys, "_s").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_s")
    before, behind = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    ranges = ranges.select(*keys, "_s", F.last("_last", True).over(before).alias("_before"), F.first("_first", True).over(behind).alias("_behind"))
    d = d.filter("_q").join(ranges, [*keys, "_s"]).withColumn("_a", F.coalesce("_a", "_before")).withColumn("_b", F.coalesce("_b", "_behind"))
    share = (F.col(x) - F.col("_a.x")) / F.nullif(F.col("_b.x") - F.col("_a.x"), F.lit(0.0))
    value = F.when(F.col("_a.x") == F.col(x), F.col("_a.y")).otherwise(F.col("_a.y") + share * (F.col("_b.y") - F.col("_a.y")))
    return d.select(*names, value.alias(y))


def param_override(base: DataFrame, free: DataFrame) -> DataFrame:
    """set_id, name, value: values of ``free`` replace those of ``base``; names of either stay."""
    new = free.select("set_id", "name", F.col("value").alias("_v"))
    return base.join(new, ["set_id", "name"], "full_outer").select("set_id", "name", F.coalesce("_v", "value").alias("value"))


def param_grid(bases: DataFrame, lists: dict[str, Sequence[float]]) -> DataFrame:
    """base_id, set_id, name, value: every combination of the lists for each base; the first parameter varies fastest. Unpacked in place, without a join."""
    total, stride, rows = 1, 1, []
    for values in lists.values():
        total *= len(values)
    for name, values in lists.items():
        place = (F.floor(F.col("set_id") / stride) % len(values) + 1).cast("int")
        rows.append(F.struct(F.lit(name).alias("name"), F.element_at(F.array(*[F.lit(float(v)) for v in values]), place).alias("value")))
        stride *= len(values)
    sets = bases.select("base_id", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("set_id"))
    return sets.select("base_id", "set_id", F.explode(F.array(*rows)).alias("_p")).select("base_id", "set_id", "_p.*")


def param_one_at_a_time(bases: DataFrame, names: Sequence[str], lists: dict[str, Sequence[float]]) -> DataFrame:
    """base_id, set_id, name, value: each listed value in turn, all other parameters (columns of ``bases``) at their base."""
    tries = [F.struct(F.lit(n).alias("n"), F.lit(float(v)).alias("v")) for n, vs in lists.items() for v in vs]
    sets = bases.select("base_id", *names, F.posexplode(F.array(*tries)).alias("set_id", "_t"))
    rows = [F.struct(F.lit(n).alias("name"), F.when(F.col("_t.n") == n, F.col("_t.v")).otherwise(F.col(n).cast("double")).alias("value")) for n in names]
    return sets.select("base_id", "set_id", F.explode(F.array(*rows)).alias("_p")).select("base_id", "set_id", "_p.*")


def alias_closure(edges: DataFrame, start: Sequence[str], hops: int = 8) -> DataFrame:
    """name: all keys that depend on the given ones, by any number of steps; edges: name, dep; circles do no harm.

    Two, four and then ``hops`` steps at a time, whose new names are written before the next ones start from them.
    """
    many = 2
    reached = front = edges.sparkSession.createDataFrame([(s,) for s in start], "name string").distinct()
    while True:
        steps = [front]
        for _ in range(min(many, hops)):
            steps.append(edges.join(steps[-1].select(F.col("name").alias("dep")), "dep").select("name").distinct())
        front = staged(reduce(DataFrame.union, steps[1:]).distinct().join(reached, "name", "left_anti"), "front")
        if front.isEmpty():
            return reached
        reached, many = staged(reached.union(front), "reached"), many * 2


def features_join(measured: DataFrame, simulated: DataFrame) -> DataFrame:
    """Measured and simulated values of each feature side by side."""
    return measured.withColumnRenamed("value", "measured").join(simulated.withColumnRenamed("value", "simulated"), ["meas_id", "feature"])


def drop_failed_fits(segs: DataFrame, fits: DataFrame) -> DataFrame:
    """Keeps the segments that have a fit."""
    return segs.join(fits.select("meas_id", "seg_pos").distinct(), ["meas_id", "seg_pos"], "left_semi")


def meas_extend(first: DataFrame, second: DataFrame) -> DataFrame:
    """Appends the segments of a second measurement table to the first's; of extra columns those that both have."""
    common = [c for c in first.columns if c in second.columns]
    shift = first.groupBy("meas_id").agg((F.max("seg_pos") + 1).alias("_n"))
    moved = second.join(shift, "meas_id", "left").withColumn("seg_pos", F.col("seg_pos") + F.coalesce("_n", F.lit(0)))
    return first.select(*common).unionByName(moved.select(*common))


def union_runs(kinds: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tables with their kind."""
    out = None
    for kind, df in kinds.items():
        d = df.withColumn("kind", F.lit(kind))
        out = d if out is None else out.unionByName(d)
    return out
