"""What grows with the input: files and their footers, plans that compute a value more than once, joins of a table with itself."""

import math
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voltlake.functions import ocv
from voltlake.operators import fits, parameters
from voltlake.plans import parameter_queries, registry
from voltlake.sources import measurements

DATA, PLATEAUS = "/root/testdata/sf0.001", [(3.9, 0.25, 0.3), (3.7, 0.5, 0.3), (3.4, 0.2, 0.4)]


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_moments_without_a_join(spark):
    df = spark.createDataFrame([(1, d, i, float((d * (i + 2)) % 5)) for d in range(9) for i in range(3)], "run_id long, draw int, i int, value double")
    out = parameters.long_moments(df)
    assert "Join" not in plan(out)
    got = {(r.i, r.j): (r.mean_i, r.cov) for r in out.collect()}
    wide = df.groupBy("draw").pivot("i", [0, 1, 2]).agg(F.first("value"))
    for i in range(3):
        for j in range(i, 3):
            want = wide.agg(F.avg(str(i)), F.covar_samp(str(i), str(j))).first()
            assert got[i, j] == pytest.approx(tuple(want))
    assert len(got) == 6


def test_inverse_is_computed_once(spark):
    df = spark.createDataFrame([(0.3,), (0.7,)], "s double")
    for f in (ocv.ocv_inverse_d1, ocv.ocv_inverse_d2):
        assert plan(df.select(f(F.col("s"), PLATEAUS, 2.0, 5.0).alias("x"))).count("aggregate(") == 1


def test_files_of_few_groups(spark, tmp_path):
    df = spark.createDataFrame([(m, s, p, float(p)) for m in range(4) for s in range(5) for p in range(3)], "meas_id long, seg_pos int, pt long, u double").coalesce(1)
    made = measurements.write_segments(df, str(tmp_path / "s"), file_groups=3).collect()
    assert sum(r.groups for r in made) == 20 and sum(r.rows for r in made) == 60 and max(r.groups for r in made) <= 3
    for r in made:
        assert pq.ParquetFile(r.uri.removeprefix("file:")).num_row_groups == r.groups
    assert spark.read.parquet(*[r.uri for r in made]).distinct().count() == 60


def test_files_in_one_folder(spark):
    """A file for each user, without a folder for each, which a listing would have to visit."""
    path = parameter_queries._user_files(spark, DATA, "u", "state").removeprefix("file:")
    users = spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().count()
    names = [n for n in os.listdir(path) if not n.startswith(".")]
    assert len(names) == users and all(os.path.isfile(f"{path}/{n}") for n in names)
    with open(f"{path}/{names[0]}") as f:
        assert f.readline() == "u;state\n"


def shuffled(spark, run):
    """Bytes that the stages of a run write for shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        none = gateway.jvm.java.util.ArrayList()
        found = sc.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    run()
    return sum(b for k, b in stages().items() if k not in before)


@pytest.mark.parametrize("name", ["fit_exp_decays", "static_features", "inverse_axis_r2"])
def test_points_of_short_segments_are_shuffled_not_their_sums(spark, name):
    """A point of events takes some 50 bytes of a shuffle; a segment's 24 sums a round took some 8000."""
    data = "/root/testdata/sf0.01"
    points = spark.read.parquet(f"{data}/events.parquet").count()
    assert shuffled(spark, lambda: registry.queries()[name](spark, data).write.format("noop").mode("overwrite").save()) < 400 * points


ODD = [None, math.nan, math.inf, -math.inf, 0.0]


def odd_segments(spark):
    """Segments of 1 to 40 points; of some keys every, or a few, values are null, NaN, infinite, zero or the same."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(80):
        for j in range(1 + k // 2):
            y = 3 + math.exp(-0.2 * j) + 0.01 * rng.standard_normal()
            if k % 8 < 5 and (j == k // 8 or k > 70):
                y = ODD[k % 8]
            rows.append((k if k != 33 else None, 1.0 + k // 2, float(j) if (k, j) != (50, 7) else None, 0.1 if k % 8 == 5 else y))
    return spark.createDataFrame(rows, "seg long, span double, x double, _y double")


def same(a, b):
    return a is None and b is None or math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-9, abs=1e-13)


@pytest.mark.parametrize("how", ["linear", "origin"])
def test_fits_by_rows_are_those_by_sums(spark, how):
    d = odd_segments(spark)
    if how == "linear":
        fit = lambda short: fits.grid_fit(d, ["seg", "span"], fits.RATES, lambda m, g, c: m.exp(-g * c("x") / c("span")), short=short)
    else:
        fit = lambda short: fits.origin_fit(d, ["seg", "span"], [0.2 + 0.1 * k for k in range(9)], lambda m, g, c: m.power(c("x"), g), 0.0, 1e3, short=short)
    by_rows, by_sums, both = ({r.seg: r for r in fit(short).collect()} for short in (fits.SHORT, 0, 12))
    assert by_rows.keys() == by_sums.keys() == both.keys() and len(by_sums) > 60 and None not in by_sums
    assert "MapInArrow" in plan(fit(12)) and "Join" in plan(fit(12)) and "Join" not in plan(fit(fits.SHORT))
    assert "MapInArrow" not in plan(fit(0))
    for k, r in by_sums.items():
        for other in (by_rows[k], both[k]):
            assert all(same(x, y) for x, y in zip(other, r)), (k, other, r)


def test_batches_of_rows_are_cut(spark):
    """The same fits where arrays hold a few points at once."""
    d = odd_segments(spark).filter("seg % 8 >= 5")
    batches = d.groupBy("seg", "span").agg(F.collect_list(F.struct("x", "_y")).alias("_p")).toArrow().combine_chunks().to_batches()
    exp, tries = (lambda m, g, c: m.exp(-g * c("x") / c("span"))), fits.tries_of(fits.RATES)
    whole = [fits.best_of_rows(b, ["seg", "span"], ["x", "_y"], tries, exp, fits.Linear(), True, 3) for b in batches]
    one = [fits.best_of_rows(b.slice(k, 1), ["seg", "span"], ["x", "_y"], tries, exp, fits.Linear(), True, 3) for b in batches for k in range(b.num_rows)]
    assert sum(len(at) for at, _ in whole) > 20
    np.testing.assert_allclose(np.concatenate([f for _, f in whole], axis=1), np.concatenate([f for _, f in one], axis=1), rtol=1e-12, atol=1e-15)
