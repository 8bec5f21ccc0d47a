"""Operators on keys of many slices, deep rules, counted selection, splines, circuits, distributions and packed matrices."""

import math
import random
import statistics as plain

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.functions import circuits as C
from voltlake.functions import distributions as D
from voltlake.operators import joins, parameters, segments, statistics


def series(spark, n=300, keys=2):
    rng = random.Random(1)
    rows = [(k, 2 * j, float(rng.randrange(40)) if j % 7 else float(j)) for k in range(keys) for j in range(n)]
    return rows, spark.createDataFrame(rows, "k long, pt long, x double").repartition(5)


def test_slices_change_no_result(spark):
    _, df = series(spark)
    small, whole = 16, 1 << 16
    for op in (lambda s: segments.noise_estimate(df, ["k"], "x", s), lambda s: segments.monotone_cleanup(df, ["k"], "x", s), lambda s: segments.nearest_crossing(df, ["k"], F.col("x"), F.lit(20.5), s)):
        a, b = (sorted(tuple(r) for r in op(s).collect()) for s in (small, whole))
        assert a == b and a
    for lags in (3, 40):
        a, b = (sorted((r.k, round(r.ess, 9)) for r in statistics.effective_sample_size(df, ["k"], "pt", "x", lags, s).collect()) for s in (small, whole))
        assert a == b


def test_noise_and_records_of_slices(spark):
    rows, df = series(spark, 60, 1)
    x = [v for _, _, v in rows]
    inner = [abs(x[j] - 0.5 * (x[j - 1] + x[j + 1])) * math.sqrt(math.pi / 2) for j in range(1, 59)]
    got = [r.noise for r in segments.noise_estimate(df, ["k"], "x", 8).orderBy("pt").collect()]
    assert got == pytest.approx([inner[0], *inner, inner[-1]])
    up, down = sum(b > a for a, b in zip(x, x[1:])), sum(b < a for a, b in zip(x, x[1:]))
    sign = 1 if up >= down else -1
    best, kept = -math.inf, []
    for v in x:
        if sign * v > best:
            best = sign * v
            kept.append(v)
    assert [r.x for r in segments.monotone_cleanup(df, ["k"], "x", 8).orderBy("ord").collect()] == sorted(kept)


def test_knots_are_carried_over_ranges(spark):
    """All knots of a key far from most of its queries, so ranges hold none."""
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 10.0), (1, 100.0, 20.0), (2, 5.0, 1.0)], "k long, x double, y double")
    asked = [(1, -1.0 + 0.25 * j) for j in range(600)] + [(2, 5.0), (2, 6.0), (3, 1.0)]
    got = {(r.k, r.x): r.y for r in joins.join_interp(spark.createDataFrame(asked, "k long, x double"), knots, ["k"]).collect()}
    want = {(1, x): None if not 0 <= x <= 100 else float(np.interp(x, [0, 1, 100], [0, 10, 20])) for k, x in asked if k == 1} | {(2, 5.0): 1.0, (2, 6.0): None, (3, 1.0): None}
    assert {k: None if v is None else round(v, 9) for k, v in got.items()} == {k: None if v is None else round(v, 9) for k, v in want.items()}


def test_two_hundred_rules_in_a_chain(spark):
    """Each rule takes the one before twice: a value is computed once, so the plan doesn't double."""
    rules = {"r0": lambda get: get("a") + 1}
    rules |= {f"r{k}": (lambda get, k=k: 0.5 * get(f"r{k - 1}") + 0.5 * get(f"r{k - 1}") + 1) for k in range(1, 200)}
    base = spark.createDataFrame([(1, "a", 0.0), (2, "a", 5.0)], "set_id long, name string, value double")
    free = spark.createDataFrame([(2, "r100", 0.0)], "set_id long, name string, value double")
    got = {(r.set_id, r.name): r.value for r in parameters.derived_parameters(base, free, rules).collect()}
    assert got[1, "r199"] == 200.0 and got[2, "r99"] == 105.0 and got[2, "r199"] == 99.0 and len(got) == 402


def test_circles_are_named():
    with pytest.raises(ValueError, match="circle"):
        parameters.rule_levels({"a": "b", "b": lambda get: get("c") + 1, "c": "a", "d": "a"})
    assert parameters.rule_levels({"a": "b", "b": "x", "c": "x"}) == [["b", "c"], ["a"]]


def test_smallest_by_counting(spark):
    """A hot key, ties beyond the crowd, infinite and missing values, against sorting."""
    rng = random.Random(3)
    rows = [(1, k, rng.choice([rng.gauss(0, 1), 0.25, 0.25, 1e300 * rng.random(), -1e308, math.inf])) for k in range(1500)] + [(2, k, 1.0) for k in range(300)] + [(3, 0, None), (3, 1, math.nan), (4, 0, 7.0)]
    df = spark.createDataFrame(rows, "k long, o long, discrepancy double").repartition(7)
    for share in (0.003, 0.3, 0.9):
        want = []
        for key in (1, 2, 4):
            own = sorted((v, o) for k, o, v in rows if k == key)
            want += [(key, o) for _, o in own[: max(1, math.floor(len(own) * share))]]
        got = parameters.smallest(df, ["k"], "discrepancy", F.greatest(F.lit(1), F.floor(F.col("_n") * share)), ["o"], crowd=20)
        assert sorted((r.k, r.o) for r in got.collect()) == sorted(want)


def spline(x, y, at):
    """Natural cubic spline by solving for the curvatures at once."""
    n, h = len(x), np.diff(x)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t = (at - x[i]) / h[i]
    return (1 - t) * y[i] + t * y[i + 1] + (((1 - t) ** 3 - (1 - t)) * m[i] + (t**3 - t) * m[i + 1]) * h[i] ** 2 / 6


def test_splines(spark):
    """Keys of many slices, of two points and of one, repeated x and missing values."""
    rng = np.random.default_rng(4)
    curves = {1: 300, 2: 5, 3: 2, 4: 3}
    rows, known = [], {}
    for k, n in curves.items():
        x, y = np.cumsum(rng.uniform(0.2, 2, n)), rng.standard_normal(n)
        known[k] = x, y
        rows += [(k, float(a), float(b)) for a, b in zip(x, y)]
    rows += [(5, 1.0, 1.0), (1, 0.5, None), (2, float(known[2][0][1]), float(known[2][1][1]) + 1)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    got = parameters.param_curve(df.withColumnRenamed("k", "key"), ["key"], "x", "y", 5, knots=64).collect()
    assert len(got) == sum(5 * (n - 1) for n in curves.values())
    by = {}
    for r in got:
        by.setdefault(r.key, []).append((r.x, r.y))
    for k, (x, y) in known.items():
        at = np.array([a for a, _ in by[k]])
        assert np.allclose([b for _, b in by[k]], spline(x, y, at), atol=1e-9)
    straight = {(r.key, r.x): r.y for r in parameters.param_curve(df.withColumnRenamed("k", "key"), ["key"], "x", "y", 3, kind="linear").collect()}
    x, y = known[2]
    assert straight[2, (x[0] + x[1]) / 2] == pytest.approx((y[0] + y[1]) / 2)


def complex_of(tree, value, w):
    kind, *rest = tree
    s = 1j * w
    v = [value[n] for n in rest] if kind not in C.PARTS else None
    if kind == "series":
        return sum(complex_of(x, value, w) for x in rest)
    if kind == "parallel":
        return 1 / sum(1 / complex_of(x, value, w) for x in rest)
    root = np.sqrt(s)
    return {"R": lambda: v[0], "C": lambda: 1 / (s * v[0]), "L": lambda: s * v[0], "Q": lambda: (v[0] * s) ** -v[1], "W": lambda: (v[0] * s) ** -0.5,
            "Wo": lambda: v[0] / np.tanh(v[1] * root) / root, "Ws": lambda: v[0] * np.tanh(v[1] * root) / root}[kind]()


@pytest.mark.parametrize("end", ["Wo", "Ws"])
def test_circuits_as_data(spark, end):
    trees = C.named_circuits(end) | {"deep": ("parallel", ("R", "R_0"), ("series", ("W", "Q_X"), ("parallel", ("Q", "Q_X", "alpha"), ("L", "L_1"))))}
    rows = [r for n, t in trees.items() for r in C.tree_rows(n, t)]
    assert C.trees_of(rows) == trees
    rng = random.Random(5)
    names = sorted({n for r in rows for n in r[4]})
    value = {n: rng.uniform(0.3, 2) for n in names}
    asked = [(c, w) for c in [*trees, "unknown"] for w in (0.01, 0.3, 1.0, 20.0, 900.0)]
    df = spark.createDataFrame([(c, value, w) for c, w in asked], "circuit string, params map<string,double>, omega double")
    got = {(r.circuit, r.omega): (r.re, r.im) for r in C.circuit_impedance(df, spark.createDataFrame(rows, C.NODES)).collect()}
    for c, w in asked:
        if c == "unknown":
            assert got[c, w] == (None, None)
        else:
            z = complex_of(trees[c], value, w)
            assert got[c, w] == pytest.approx((z.real, z.imag), rel=1e-9, abs=1e-12)


def test_quantiles(spark):
    ps = [1e-300, 1e-20, 1e-6, 0.01, 0.074, 0.3, 0.5, 0.77, 0.93, 0.99999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    z = [r.z for r in df.select(D.normal_quantile(F.col("p")).alias("z")).collect()]
    normal = plain.NormalDist()
    assert z == pytest.approx([normal.inv_cdf(p) for p in ps], rel=1e-14, abs=1e-15)
    xs = [-9.0, -8.0, -3.3, -0.5, 0.0, 1.0, 2.7, 8.1, 10.0]
    got = [r.z for r in spark.createDataFrame([(x,) for x in xs], "x double").select(D.normal_probability(F.col("x")).alias("z")).collect()]
    assert got == pytest.approx([normal.cdf(x) for x in xs], abs=1e-14)
    laws = [("normal", [1.0, 2.0]), ("uniform", [-1.0, 3.0]), ("lognormal", [0.5, 0.3]), ("triangular", [0.0, 1.0, 4.0]), ("truncated normal", [0.0, 1.0, 3.0, 5.0]), ("truncated normal", [0.0, 1.0, -0.5, 0.2]), ("loguniform", [1.0, 100.0]), ("exponential", [1.0, 2.0]), ("logistic", [0.0, 2.0])]
    d = spark.createDataFrame(laws, "kind string, a array<double>").crossJoin(spark.createDataFrame([(k / 10,) for k in range(1, 10)], "p double"))

    def cdf(kind, a, x):
        if kind == "truncated normal":
            n = plain.NormalDist(a[0], a[1])
            return (n.cdf(x) - n.cdf(a[2])) / (n.cdf(a[3]) - n.cdf(a[2]))
        return {"normal": lambda: plain.NormalDist(*a).cdf(x), "uniform": lambda: (x - a[0]) / (a[1] - a[0]), "lognormal": lambda: plain.NormalDist(*a).cdf(math.log(x)),
                "triangular": lambda: x**2 / 4 if x < 1 else 1 - (4 - x) ** 2 / 12, "loguniform": lambda: math.log(x) / math.log(100), "exponential": lambda: 1 - math.exp(-(x - 1) / 2), "logistic": lambda: 1 / (1 + math.exp(-x / 2))}[kind]()

    for r in d.select("kind", "a", "p", D.quantile(F.col("kind"), F.col("p"), F.col("a")).alias("x")).collect():
        assert cdf(r.kind, r.a, r.x) == pytest.approx(r.p, abs=1e-9), r
    with pytest.raises(Exception, match="no distribution"):
        spark.range(1).select(D.quantile(F.lit("none"), F.lit(0.5), F.array(F.lit(1.0)))).collect()


def test_draws_follow_their_distribution(spark):
    """Largest distance of 4000 draws' shares from the distribution, below the Kolmogorov-Smirnov bound for 1 in 10,000."""
    sets = spark.range(4000).select(F.col("id").alias("set_id"), F.lit("a").alias("name"), F.lit(0.0).alias("value"))
    laws = spark.createDataFrame([("a", "truncated normal", [0.0, 1.0, -0.5, 2.0])], "name string, kind string, arguments array<double>")
    x = np.sort([r.value for r in parameters.parameter_noise(sets, laws, 3).collect()])
    n = plain.NormalDist()
    f = np.array([(n.cdf(v) - n.cdf(-0.5)) / (n.cdf(2.0) - n.cdf(-0.5)) for v in x])
    assert np.abs(f - (np.arange(4000) + 0.5) / 4000).max() < 2.23 / math.sqrt(4000)


@pytest.mark.parametrize("d", [1, 2, 7])
def test_packed_inverses(spark, d):
    """Covariance, correlation, mean and bounds of runs and features against NumPy; indefinite ones have no row."""
    rng = np.random.default_rng(6)
    mats = {(k, f): (lambda a: a @ a.T + np.eye(d))(rng.standard_normal((d, d))) for k in range(3) for f in "xy"}
    mats[9, "x"] = -np.eye(d)
    vec = {k: rng.standard_normal(d) for k in mats}
    q = spark.createDataFrame([(*k, i, j, float(m[i, j])) for k, m in mats.items() for i in range(d) for j in range(d)], "run_id long, feature string, i int, j int, q double")
    r = spark.createDataFrame([(*k, i, float(v[i])) for k, v in vec.items() for i in range(d)], "run_id long, feature string, i int, r double")
    got = {(x.run_id, x.feature, x.i, x.j): (x.covariance, x.correlation) for x in parameters.site_matrices(q, d, ["run_id", "feature"]).collect()}
    rep = {(x.run_id, x.feature, x.i): x for x in parameters.site_report(q, r, d, ["run_id", "feature"], ["log"] * d).collect()}
    assert len(got) == 6 * d * d and len(rep) == 6 * d
    for (k, f), m in mats.items():
        if k < 9:
            cov = np.linalg.inv(m)
            for i in range(d):
                for j in range(d):
                    assert got[k, f, i, j] == pytest.approx((cov[i, j], cov[i, j] / math.sqrt(cov[i, i] * cov[j, j])), rel=1e-9, abs=1e-12)
                x, mean, s = rep[k, f, i], (cov @ vec[k, f])[i], math.sqrt(cov[i, i])
                bound = statistics.chi2_95(d) ** 0.5 * s
                assert (x.mean, x.std, x.low, x.high, x.guess, x.upper) == pytest.approx((mean, s, mean - bound, mean + bound, math.exp(mean), math.exp(mean + bound)), rel=1e-9)


def test_labels_of_known_clusters(spark):
    """Three well separated kinds of segments: one cluster each, named by what varies less."""
    from voltlake.operators.clustering import label_cycles

    rng = np.random.default_rng(7)
    kinds = [((1.0, 1e-6, 3.5, 0.2), "constant current"), ((-1.0, 1e-6, 3.1, 0.3), "constant current"), ((0.2, 0.4, 4.2, 1e-6), "constant voltage")]
    rows = [(k, j, *(float(v * (1 + 0.01 * rng.standard_normal())) for v in kinds[k % 3][0])) for k in range(30) for j in range(5)]
    got = label_cycles(spark.createDataFrame(rows, "meas_id long, seg_pos int, i_mean double, i_var double, u_mean double, u_var double"), 6).collect()
    by = {}
    for r in got:
        by.setdefault(r.meas_id % 3, set()).add((r.cluster, r["name"]))
    assert all(len(v) == 1 for v in by.values()) and len({c for v in by.values() for c, _ in v}) == 3
    assert {k: next(iter(v))[1] for k, v in by.items()} == {k: name for k, (_, name) in enumerate(kinds)}


def test_losses_of_models(spark):
    """The model that made the points has no loss; orders 1, 2 and infinite against plain Python."""
    from voltlake.functions.ocv import slope_unit

    models = {"true": [(3.9, 0.25, 0.3), (3.7, 0.5, 0.3), (3.4, 0.2, 0.4)], "off": [(3.8, 0.25, 0.3), (3.7, 0.5, 0.3), (3.4, 0.2, 0.4)]}
    term = lambda e, p: math.exp((e - p[0]) * p[1] * slope_unit())
    soc = lambda e, m: sum(p[2] / (1 + term(e, p)) for p in m)
    slope = lambda e, m: sum(p[2] * p[1] * slope_unit() * term(e, p) / (1 + term(e, p)) ** 2 for p in m)
    points = [(1, 3.2 + 0.02 * k, soc(3.2 + 0.02 * k, models["true"]), 1.0 + k % 2) for k in range(50)]
    df = spark.createDataFrame(points, "k long, e double, soc double, weight double")
    table = spark.createDataFrame([(n, m, 0.0, 1.0) for n, m in models.items()], "candidate string, plateaus array<struct<e0:double,a:double,dx:double>>, start double, end double")
    for order in (1.0, 2.0, math.inf):
        got = {r.candidate: r.loss for r in statistics.ocv_losses(df, table, ["k"], order).collect()}
        off = [w * abs(soc(e, models["off"]) - x) for _, e, x, w in points]
        want = max(off) if order == math.inf else sum(o**order / (1 + slope(e, models["off"]) ** order) for o, (_, e, _, _) in zip(off, points)) ** (1 / order)
        assert got["true"] < 1e-12 and got["off"] == pytest.approx(want, rel=1e-9)


def test_parameters_of_circuits_are_looked_up_once(spark):
    """However deep the trees, a row's map is searched once for each name."""
    trees = C.named_circuits("Wo")
    names = {n for name, t in trees.items() for r in C.tree_rows(name, t) for n in r[4]}
    df = spark.createDataFrame([("scrf", {n: 1.0 for n in names}, 0.0), ("scrf", {}, 1.0), ("debye", {n: 1.0 for n in names}, 1.0)], "circuit string, params map<string,double>, omega double")
    out = C.circuit_impedance(df, spark.createDataFrame([r for n, t in trees.items() for r in C.tree_rows(n, t)], C.NODES))
    assert out._jdf.queryExecution().analyzed().toString().count("try_element_at") <= len(names)
    got = {(r.circuit, r.omega): (r.re, r.im) for r in out.collect()}
    assert got["scrf", 0.0] == got["scrf", 1.0] == (None, None)
    assert got["debye", 1.0] == pytest.approx((0.25 * 2, -0.5 - 1.0))


def test_draws_are_not_broadcast(spark):
    """Draws are estimated by the small table that they come of."""
    from voltlake.plans import registry

    assert "BroadcastExchange" not in registry.queries()["prior_draws"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_stacks_of_runs(spark):
    """Runs of one and of three parameters, an indefinite one and one without a mean, in one batch."""
    rng = np.random.default_rng(2)
    mats = {1: np.array([[4.0]]), 2: (lambda a: a @ a.T + np.eye(3))(rng.standard_normal((3, 3))), 3: np.diag([1.0, -1.0]), 4: np.eye(2)}
    q = spark.createDataFrame([(k, i, j, float(m[i, j])) for k, m in mats.items() for i in range(len(m)) for j in range(len(m))], "run_id long, i int, j int, q double")
    r = spark.createDataFrame([(k, i, 1.0 + i) for k, m in mats.items() if k != 4 for i in range(len(m))], "run_id long, i int, r double")
    white = {}
    for x in parameters.whitening(q, r).collect():
        white.setdefault(x.run_id, {})[x.i, x.j] = x
    assert sorted(white) == [1, 2]
    for k, cells in white.items():
        d = len(mats[k])
        m = np.array([[cells[i, j].m for j in range(d)] for i in range(d)])
        assert np.allclose(m @ m.T, np.linalg.inv(mats[k])) and np.allclose([cells[i, 0].mean_i for i in range(d)], np.linalg.solve(mats[k], 1.0 + np.arange(d)))
    moments = spark.createDataFrame([(1, 0, 0, 2.0, 0.5), (3, 0, 0, 1.0, 1.0), (3, 0, 1, 1.0, 1.0), (3, 1, 1, 1.0, 1.0)], "run_id long, i int, j int, mean_i double, cov double")
    got = {(x.run_id, x.what, x.i, x.j): x.value for x in parameters.ep_site_update(moments, q, r, None, None, 0.5).collect()}
    assert got[1, "Q", 0, 0] == pytest.approx(3.0) and got[1, "r", 0, 0] == pytest.approx(2.5) and got[1, "site Q", 0, 0] == pytest.approx(-1.0)
    assert all(got[2, "Q", i, j] == mats[2][i, j] for i in range(3) for j in range(3)) and got[3, "Q", 1, 1] == -1.0 and got[3, "site Q", 0, 0] == 0.0
