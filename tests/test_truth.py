"""Closed-form truth, limits and edge cases of the measurement operators."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voltlake.functions import circuits as C
from voltlake.functions import ocv as O
from voltlake.operators import clustering, fits, joins, parameters, segments, statistics
from voltlake.sources import measurements

PLATEAUS = [(3.9, 0.25, 0.3), (3.7, 0.5, 0.3), (3.4, 0.2, 0.4)]


def points(spark, rows):
    return spark.createDataFrame(rows, "meas_id long, seg_pos int, pt long, t double, i double, u double")


def test_exponential_recovers_known_decay(spark):
    rate = fits.RATES[10] / 100
    df = points(spark, [(1, 0, k, k * 5.0, 0.0, 3.5 + 0.2 * math.exp(-rate * k * 5.0)) for k in range(21)])
    r = fits.fit_exp_decay(df).first()
    assert (r.asymptote, r.amplitude, r.rate) == pytest.approx((3.5, 0.2, rate), rel=3e-4)


def test_square_root_recovers_known_slope(spark):
    df = points(spark, [(1, 0, k, float(k), 0.0, 3.0 + 0.1 * math.sqrt(k)) for k in range(20)])
    r = fits.fit_sqrt(df).first()
    assert (r.share, r.b, r.c, r.r2) == pytest.approx((0.5, 3.0, 0.1, 1.0), rel=1e-9)  # the first half reaches the threshold


def test_short_and_flat_segments_have_no_fit(spark):
    df = points(spark, [(1, 0, 0, 0.0, 0.0, 1.0), (1, 0, 1, 1.0, 0.0, 2.0)])
    assert fits.fit_exp_decay(df).count() == 0 and fits.fit_sqrt(df).count() == 0


def test_power_law_recovers_exponent(spark):
    df = points(spark, [(1, 0, k, float(k), 0.0, 1.0 + 0.5 * k**0.7) for k in range(20)])
    r = fits.fit_power_law(df, [0.5, 0.6, 0.7, 0.8], 10.0).first()
    assert (r.exponent, r.k) == pytest.approx((0.7, 0.5), rel=1e-4)


def test_model_and_inverse_are_identity(spark):
    df = spark.range(1, 100).select((F.col("id") / 100).alias("s"))
    e = O.ocv_model_inverse(F.col("s"), PLATEAUS, 2.0, 5.0)
    back = df.select("s", O.ocv_model_soc(e, PLATEAUS).alias("b")).collect()
    assert all(abs(r.s - r.b) < 1e-9 for r in back)
    assert df.limit(1).select(O.ocv_model_inverse(F.lit(2.0), PLATEAUS, 2.0, 5.0)).first()[0] is None


def test_second_derivative_by_differences(spark):
    e, h = F.col("e"), 1e-4
    df = spark.range(30).select((3.0 + F.col("id") / 20).alias("e"))
    second = (O.ocv_model_d1(e + h, PLATEAUS) - O.ocv_model_d1(e - h, PLATEAUS)) / (2 * h)
    assert all(abs(r.a - r.b) < 1e-3 for r in df.select(O.ocv_model_d2(e, PLATEAUS).alias("a"), second.alias("b")).collect())


def test_shares_are_completed():
    assert O.complete([(3.9, 1.0, 0.25), (3.7, 1.0)])[1][2] == 0.75


def test_circuit_limits(spark):
    w = F.col("w")
    z = C.randles(F.lit(0.5), F.lit(2.0), F.lit(1e-3), C.resistor(F.lit(0.0)), w)
    low, high = (r.re for r in spark.createDataFrame([(1e-9,), (1e9,)], "w double").select(z.re.alias("re")).collect())
    assert (low, high) == pytest.approx((2.5, 0.5), abs=1e-6)
    short, open_ = C.warburg_short(F.lit(3.0), F.lit(2.0), w), C.warburg_open(F.lit(3.0), F.lit(2.0), w)
    r = spark.createDataFrame([(1e-10,)], "w double").select(short.re.alias("a"), (open_.im * w).alias("b")).first()
    assert (r.a, r.b) == pytest.approx((6.0, -1.5), rel=1e-6)
    assert spark.createDataFrame([(0.0,)], "w double").select(C.capacitor(F.lit(1.0), w).im.alias("x")).first().x is None


def test_crossing_ends_and_exact_hits(spark):
    df = points(spark, [(1, 0, k, float(k), 0.0, u) for k, u in enumerate([0.0, 1.0, 2.0, 3.0])])
    at = lambda v: segments.nearest_crossing(df, ["meas_id"], F.col("u"), F.lit(v)).first().pos
    assert (at(1.4), at(1.6), at(2.0), at(-5.0), at(9.0)) == (1, 2, 2, 0, 3)


def test_unmapped_state_is_named(spark):
    df = spark.createDataFrame([("X", 1.0)], "state string, i double")
    with pytest.raises(Exception, match="no sign for state X"):
        segments.state_sign(df, {"C": 1}, "state", "i").collect()


def test_charge_counts_nothing_between_segments(spark):
    df = points(spark, [(1, 0, 0, 0.0, 1.0, 0.0), (1, 0, 1, 2.0, 1.0, 0.0), (1, 1, 0, 100.0, 1.0, 0.0), (1, 1, 1, 101.0, 3.0, 0.0)])
    assert [r.soc for r in segments.coulomb_count(df).orderBy("seg_pos", "pt").collect()] == [0.0, 2.0, 2.0, 4.0]


def test_interpolation_hits_knots_and_is_null_outside(spark):
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 4.0)], "k int, x double, y double")
    asked = spark.createDataFrame([(1, x) for x in (-1.0, 0.0, 0.5, 2.0, 3.0)] + [(2, 1.0)], "k int, x double")
    got = {(r.k, r.x): r.y for r in joins.join_interp(asked, knots, ["k"]).collect()}
    assert got == {(1, -1.0): None, (1, 0.0): 0.0, (1, 0.5): 1.0, (1, 2.0): 4.0, (1, 3.0): None, (2, 1.0): None}


def test_alias_chain_follows_all_steps(spark):
    edges = spark.createDataFrame([("dolor", "ipsum"), ("sit", "lorem"), ("amet", "dolor"), ("amet", "sit")], "name string, dep string")
    assert {r.name for r in joins.alias_closure(edges, ["ipsum"]).collect()} == {"ipsum", "dolor", "amet"}


def test_missing_source_row_fails(spark):
    segs = spark.createDataFrame([(1, 5)], "meas_id long, seg_pos int")
    ocv = spark.createDataFrame([(1, 9, 9, 0.5)], "meas_id long, source_index int, pos int, soc double")
    with pytest.raises(Exception, match="no OCV row"):
        joins.join_source_index(segs, ocv, "soc").collect()


def test_undamped_update_equals_sample_gaussian(spark):
    m = spark.createDataFrame([(1, 0, 0, 2.0, 4.0), (1, 0, 1, 2.0, 1.0), (1, 1, 1, 3.0, 9.0)], "run_id long, i int, j int, mean_i double, cov double")
    q = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, 1.0)], "run_id long, i int, j int, q double")
    r = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0)], "run_id long, i int, r double")
    out = parameters.ep_site_update(m, q, r, q.withColumn("q", F.lit(0.0)), r.withColumn("r", F.lit(0.0)), 0.0)
    nq = out.filter("what = 'Q'").select("run_id", "i", "j", F.col("value").alias("q"))
    nr = out.filter("what = 'r'").select("run_id", "i", F.col("value").alias("r"))
    got = {x.i: (x.mean, x.std) for x in parameters.site_report(nq, nr, 2).collect()}
    assert got[0] == pytest.approx((2.0, 2.0)) and got[1] == pytest.approx((3.0, 3.0))


def test_indefinite_precision_is_skipped(spark):
    q = spark.createDataFrame([(1, 0, 0, -1.0)], "run_id long, i int, j int, q double")
    r = spark.createDataFrame([(1, 0, 0.0)], "run_id long, i int, r double")
    assert parameters.whitening(q, r).count() == 0 and parameters.site_report(q, r, 1).count() == 0


def test_draws_follow_their_prior(spark):
    q = spark.createDataFrame([(1, 0, 0, 4.0)], "run_id long, i int, j int, q double")
    r = spark.createDataFrame([(1, 0, 8.0)], "run_id long, i int, r double")
    d = parameters.prior_draws(parameters.whitening(q, r), 4000, 3).agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).first()
    assert d.m == pytest.approx(2.0, abs=0.03) and d.s == pytest.approx(0.5, rel=0.15)


def test_loop_moves_towards_the_measurement(spark):
    q = spark.createDataFrame([(1, 0, 0, 0.25), (1, 1, 1, 0.25)], "run_id long, i int, j int, q double")
    r = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0)], "run_id long, i int, r double")
    measured = spark.createDataFrame([("f0", 2.0, 1.0), ("f1", -2.0, 1.0)], "feature string, value double, weight double")
    simulate = lambda d: d.select("run_id", "draw", F.concat(F.lit("f"), F.col("i").cast("string")).alias("feature"), "value")
    out = parameters.ep_loop(q, r, measured, ["f0", "f1"], simulate, 2, 400, 0.1)
    part = lambda what, *c: out.filter(F.col("what") == what).select("run_id", *c, F.col("value").alias(what.lower()))
    got = {x.i: x.mean for x in parameters.site_report(part("Q", "i", "j"), part("r", "i"), 2).collect()}
    assert got[0] > 1.0 and got[1] < -1.0
    with pytest.raises(ValueError, match="one iteration"):
        parameters.ep_loop(q, r, measured, ["f0"], simulate, 2, 10, 0.5)


def test_four_digits(spark):
    df = spark.createDataFrame([(0.5,), (12.0,), (1234.56,), (0.00012346,), (0.0,)], "x double")
    assert [r.s for r in df.select(statistics.four_digits(F.col("x")).alias("s")).collect()] == ["0.5", "12", "1235", "0.0001235", "0"]


def test_headers():
    assert measurements.unit_factor("I [mA]") == ("I", 1e-3) and measurements.unit_factor("t [h]") == ("t", 3600.0)
    assert measurements.unit_factor("real_Z [Ω]") == ("real_Z", 1.0) and measurements.unit_factor("note") == ("note", 1.0)


def test_instrument_file(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"run{k}.txt").write_bytes(f"# caf\xe9 \"{k}\nt\tU\n".encode("latin-1") + "".join(f"{j}\t{j * k},5\tR{j}\n" for j in range(50)).encode())
    df = measurements.read_instrument_csv(spark, str(tmp_path), {0: "t [h]", 1: "U [mV]", 2: "state"}, skip=2, encoding="iso-8859-1", symbol=",", limit=40)
    rows = df.filter("file like '%run2.txt'").orderBy("pt").collect()
    assert len(rows) == 40 and [r.pt for r in rows] == list(range(40))
    assert rows[3].t == 3 * 3600.0 and rows[3].U == pytest.approx(6.5e-3) and rows[3].state_text == "R3" and rows[3].state is None
    assert measurements.comment_lines(spark, str(tmp_path), 2, "latin-1").count() == 4


def test_empty_table(spark):
    df = points(spark, [])
    assert segments.segment_by_change(df.withColumn("state", F.lit("a")), "state").count() == 0
    assert statistics.protocol_text(df).count() == 0 and fits.gitt_features(df).count() == 0


def test_derived_parameters_follow_changes(spark):
    rules = {"dolor": "ipsum", "sit": lambda get: get("lorem"), "amet": lambda get: get("dolor") + get("sit")}
    base = spark.createDataFrame([(k, n, v) for k in (0, 1, 2) for n, v in (("lorem", 1.0), ("ipsum", 2.0))], "set_id long, name string, value double")
    free = spark.createDataFrame([(1, "lorem", 2.0), (1, "ipsum", 4.0), (2, "dolor", 9.0)], "set_id long, name string, value double")
    got = {(r.set_id, r.name): r.value for r in parameters.derived_parameters(base, free, rules).collect()}
    want = {0: (1.0, 2.0, 2.0, 1.0, 3.0), 1: (2.0, 4.0, 4.0, 2.0, 6.0), 2: (1.0, 2.0, 9.0, 1.0, 10.0)}
    assert got == {(k, n): v for k, values in want.items() for n, v in zip(("lorem", "ipsum", "dolor", "sit", "amet"), values, strict=True)}
    with pytest.raises(ValueError, match="circle"):
        parameters.derived_parameters(base, free, {"a": "b", "b": "a"})


def test_alias_closure_of_long_chains_quotes_and_circles(spark):
    edges = [(f"k{i + 1}", f"k{i}") for i in range(110)] + [("it's", "k3"), ("k0", "k110"), ("other", "else")]
    got = {r.name for r in joins.alias_closure(spark.createDataFrame(edges, "name string, dep string"), ["k0"]).collect()}
    assert got == {f"k{i}" for i in range(111)} | {"it's"}


def test_chi_squared_of_any_degree():
    known = {1: 3.841458820694124, 2: 5.991464547107979, 3: 7.814727903251179, 10: 18.307038053275146, 25: 37.65248413348277, 100: 124.34211340400407}
    assert all(abs(statistics.chi2_95(d) - v) < 1e-9 * v for d, v in known.items())


def test_slow_chains_need_more_lags(spark):
    rng = np.random.default_rng(0)
    slow = np.cumsum(rng.normal(size=400)) * 0.05 + np.sin(np.arange(400) / 60)
    rows = [("slow", k, float(v)) for k, v in enumerate(slow)] + [("fast", k, float(v)) for k, v in enumerate(rng.normal(size=300))] + [("one", 0, 1.0)]
    got = {r.key: r.ess for r in statistics.effective_sample_size(spark.createDataFrame(rows, "key string, o long, x double"), ["key"], "o", "x", lags=7).collect()}
    for key in ("slow", "fast"):
        x = np.array([v for k, _, v in rows if k == key])
        d, total, lag = x - x.mean(), 0.0, 1
        while lag < len(d) and (c := (d[lag:] * d[:-lag]).sum() / (d * d).sum()) > 0:
            total, lag = total + c, lag + 1
        assert got[key] == pytest.approx(len(d) / (1 + 2 * total))
        assert key == "fast" or lag > 25
    assert got["one"] == 1.0


def test_changes_are_counted_over_slices(spark):
    rng = np.random.default_rng(1)
    states = [[None, "a", "b"][k] for k in rng.integers(0, 3, 500)]
    rows = [(m, k, states[(k + 13 * m) % 500]) for m in range(3) for k in range(200)]
    df = spark.createDataFrame(rows, "meas_id long, pt long, state string").repartition(4)
    got = {(r.meas_id, r.pt): r.seg_pos for r in segments.segment_by_change(df, "state", slice_points=7).collect()}
    for m in range(3):
        at, own = 0, [s for i, _, s in rows if i == m]
        for k, s in enumerate(own):
            at += k > 0 and s != own[k - 1]
            assert got[m, k] == at


def test_plateaus_of_known_clusters(spark):
    rng = np.random.default_rng(2)
    volts = np.concatenate([3.9 + rng.normal(0, 0.002, 300), 3.6 + rng.normal(0, 0.002, 500), 3.2 + rng.normal(0, 0.002, 200)])
    rows = [(m, k, float(v), k / 999) for m in (1, 2) for k, v in enumerate(volts)] + [(3, 0, 3.0, 0.5), (3, 1, 3.0, 0.6)]
    df = spark.createDataFrame(rows, "meas_id long, pt long, e double, soc double")
    got = [clustering.plateau_clusters(df.repartition(n), 3).orderBy("meas_id", "k").collect() for n in (2, 5)]
    assert got[0] == got[1]
    for m in (1, 2):
        own = [r for r in got[0] if r.meas_id == m]
        assert [r.k for r in own] == [0, 1, 2] and [round(r.e0, 2) for r in own] == [3.9, 3.6, 3.2] and [round(r.share, 1) for r in own] == [0.3, 0.5, 0.2]
    assert [(r.k, r.e0, r.share, r.slope) for r in got[0] if r.meas_id == 3] == [(0, 3.0, 1.0, 1.0)]


def test_static_read_and_row_groups(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t = np.arange(0, 40, 1.0)
    lines = ["# comment", "t;I;U;step"] + [f"{x};{2 * np.exp(-0.2 * x) + 0.5};{1000 * (3 + np.exp(-0.1 * x))};{int(x >= 30)}" for x in t]
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines) + "\n")
    d = measurements.read_instrument(spark, str(tmp_path / "in"), {0: "t [s]", 1: "I [A]", 2: "U [mV]"}, skip=2, delimiter=";", segment_column=3, datatype="static")
    r = d.filter("seg_pos = 0").first()
    assert (r.asymptotic_voltage, r.i_asymptote) == pytest.approx((3.0, 0.5), abs=0.1) and d.count() == 40 and d.filter("seg_pos = 1").count() == 10
    made = measurements.write_segments(d.withColumn("meas_id", F.lit(1)), str(tmp_path / "out")).collect()
    assert sum(r.groups for r in made) == 2 and sum(r.rows for r in made) == 40
    assert sum(pq.ParquetFile(r.uri.removeprefix("file:").replace("//", "/")).num_row_groups for r in made) == 2


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"{k}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = measurements.numbered_lines(spark, str(tmp_path / "x.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.n, int(r.line)) for r in got) == [(k, k) for k in range(5000)]


def test_windows_of_gitt_features(spark):
    b = points(spark, [(1, 0, k, float(k), 1.0, 3 + math.exp(-0.3 * k) + (5.0 if k < 4 else 0.0)) for k in range(40)])
    whole = {r.feature: r.value for r in fits.gitt_features(b).collect()}
    cut = {r.feature: r.value for r in fits.gitt_features(b, exp_window=(4.0, None), sqrt_window=(4.0, 30.0)).collect()}
    assert abs(cut[1]) < 2 < abs(whole[1]) and set(cut) == set(whole) == {0, 1, 2, 3, 4}


def test_rates_are_continuous(spark):
    """Planted rates between the grid's values, over the whole and over trailing stretches."""
    rates = [0.011, 0.0437, 0.123, 0.3071, 0.47]
    rows = [(k, 0, j, float(j), 0.0, 3.0 + 0.2 * math.exp(-d * j)) for k, d in enumerate(rates) for j in range(101)]
    got = {r.meas_id: r for r in fits.fit_exp_decay(points(spark, rows)).collect()}
    assert all(abs(got[k].rate / d - 1) < 1e-3 and abs(got[k].asymptote - 3.0) < 1e-4 for k, d in enumerate(rates))
    both = [(k, 0, j, float(j), 0.0, 3.0 + 0.2 * math.exp(-d * j) + (0.5 * math.exp(-2.0 * j) if j < 20 else 0)) for k, d in enumerate(rates[:3]) for j in range(101)]
    slow = {r.meas_id: r for r in fits.fit_exp_decays(points(spark, both), 0.999999).collect() if r["pass"] == 0}
    assert all(abs(slow[k].rate / d - 1) < 1e-3 for k, d in enumerate(rates[:3]))


def test_rates_that_the_data_cant_tell_are_lower_bounds(spark):
    """The decay is over before the second point: any faster rate fits as well, up to rounding."""
    rows = [(1, 0, k, 10.0 * k, 0.0, u) for k, u in enumerate([5.0, 1.0, 1.2, 0.8, 1.0])]
    r = fits.fit_exp_decay(points(spark, rows)).first()
    assert 0.2 < r.rate < 2.0 and abs(r.sse - 0.08) < 1e-6


def test_power_law_exponents_are_continuous(spark):
    rows = [(k, 0, j, float(j), 0.0, 2.0 + 0.3 * j**n) for k, n in enumerate((0.537, 0.811, 1.03)) for j in range(60)]
    got = {r.meas_id: r.exponent for r in fits.fit_power_law(points(spark, rows), [0.5 + 0.05 * k for k in range(13)], 10.0).collect()}
    assert all(abs(got[k] - n) < 1e-4 for k, n in enumerate((0.537, 0.811, 1.03)))


def halved(t, u, threshold):
    """The stretch found by plain halving, with each stretch fitted by itself."""
    def r2(m):
        x = np.sqrt(np.array(t[:m]) - t[0])
        if m < 4 or (x - x.mean()) @ (x - x.mean()) == 0:
            return -1e300
        c = ((x - x.mean()) @ np.array(u[:m])) / ((x - x.mean()) @ (x - x.mean()))
        b = np.mean(u[:m]) - c * x.mean()
        back = ((np.array(u[:m]) - b) / c) ** 2
        tau = np.array(t[:m]) - t[0]
        return 1 - ((tau - back) ** 2).sum() / ((tau - tau.mean()) ** 2).sum()

    n = len(t)
    d, k, best = 0, 0, n // 2
    now = most = r2(best)
    while now < threshold and (k + 1) * n // 2**d - k * n // 2**d > 1:
        left, right = (4 * k + 1) * n // 2 ** (d + 2), (4 * k + 3) * n // 2 ** (d + 2)
        lower = r2(left) > r2(right)
        m = left if lower else right
        now = r2(m)
        if now >= threshold or now > most:
            best = m
        most, d, k = max(most, now), d + 1, 2 * k + (not lower)
    return best, r2(best)


def test_leading_stretches_by_halving(spark):
    """Segments of many slices and of several rounds of halving, with gaps in pt, against plain Python."""
    rng = np.random.default_rng(5)
    rows, want, sizes = [], {}, (4, 7, 16, 33, 100, 257, 700)
    for k, n in enumerate(sizes):
        t, u = [float(j) for j in range(n)], [3 + 0.1 * math.sqrt(j) + (0.02 * rng.standard_normal() if j < n * 0.7 else 0.3 * rng.standard_normal()) for j in range(n)]
        rows += [(k, 0, 3 * j, t[j] + 5.0, 0.0, u[j]) for j in range(n)]
        want[k] = halved(t, u, 0.9)
    got = {r.meas_id: r for r in fits.fit_sqrt(points(spark, rows), 0.9, slice_points=32, levels=5).collect()}
    assert {k: round(r.share * sizes[k]) for k, r in got.items()} == {k: m for k, (m, r2) in want.items() if r2 > -1e300}
    assert all(abs(got[k].r2 - r2) < 1e-6 for k, (_, r2) in want.items() if k in got)


def test_numbers_run_over_slices(spark):
    from voltlake.operators.segments import numbered

    rows = [(k % 3, 0, 7 * k, float(k), 0.0, 0.0) for k in range(100)]
    got = sorted((r.meas_id, r.pt, r.k, r.n) for r in numbered(points(spark, rows), ["meas_id"], "k", "n", 50).collect())
    assert got == sorted((m, 7 * k, k // 3 + 1, len(range(m, 100, 3))) for m in range(3) for k in range(m, 100, 3))


TEXTS = ["# c\u00e4f\u00e9\n\n\nt\tU\n1\t2\n\n3\t4\n\n", "\n", "no end", "a\r\nb\r\n\r\nc", "", "x" * 5000 + "\n" + "y\n" * 300, "\u0a00\u000a\u0a0a\u0b0a\n\u0a0a"]


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-16", "utf-16-be", "utf-32", "utf-8-sig", "cp1252"])
def test_every_line_is_kept(spark, tmp_path, encoding):
    """Blank lines in front, among and behind data; files in many ranges; compared with what Python reads."""
    want = []
    for k, text in enumerate(TEXTS):
        data = text.encode(encoding, "replace")
        (tmp_path / f"f{k}.txt").write_bytes(data)
        with open(tmp_path / f"f{k}.txt", encoding=encoding) as f:
            want += [(f"f{k}.txt", n, line.removesuffix("\n")) for n, line in enumerate(f)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("7", "64", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = measurements.numbered_lines(spark, str(tmp_path), encoding, int(size)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert sorted((r.file.rpartition("/")[2], r.n, r.line) for r in got) == sorted(want)


def test_comments_may_be_blank(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# comment\n\nt\tU\n0\t1\n\n2\t3\n4\t5\n")
    (tmp_path / "b.txt").write_bytes("t\tU\n0\t\u00b5\n7\t8,5\n".encode("utf-16"))
    d = measurements.read_instrument_csv(spark, str(tmp_path / "a.txt"), {0: "t [s]", 1: "U [V]"}, skip=3).orderBy("pt")
    assert [(r.pt, r.t, r.U) for r in d.collect()] == [(0, 0.0, 1.0), (1, None, None), (2, 2.0, 3.0), (3, 4.0, 5.0)]
    catalog = spark.createDataFrame([(str(tmp_path / "a.txt"), "first", None, 3, None), (str(tmp_path / "b.txt"), "second", "utf-16", 1, ",")], "path string, name string, encoding string, skip int, symbol string")
    both = measurements.by_catalog(spark, catalog, {0: "t [s]", 1: "U"})
    assert sorted((r.name, r.pt, r.U or -1.0, r.U_text) for r in both.select("name", "pt", "U", "U_text").collect()) == [("first", 0, 1.0, None), ("first", 1, -1.0, None), ("first", 2, 3.0, None), ("first", 3, 5.0, None), ("second", 0, -1.0, "\u00b5"), ("second", 1, 8.5, None)]
