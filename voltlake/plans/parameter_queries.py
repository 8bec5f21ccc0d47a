"""Queries of parameter space, posterior statistics, scalar formulas, circuits and sources, and their SQL."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltlake.functions import circuits as C
from voltlake.functions import distributions as D
from voltlake.functions import ocv as O
from voltlake.operators import parameters as P
from voltlake.operators import segments as S
from voltlake.operators import statistics as A
from voltlake.operators.joins import initial_concentration, lookup_nearest
from voltlake.operators.storage import new_path, staged
from voltlake.plans.curve_queries import PROTOCOL_SQL, sigs
from voltlake.plans.fit_queries import sig, sq
from voltlake.plans.segment_queries import ENDS_SQL
from voltlake.plans.views import BLOCKS_SQL, RAW_SQL, SIGNS, SPECTRA_SQL, blocks, r, raw_points, spectra, table
from voltlake.sources import measurements as M

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


CHI = {d: A.chi2_95(d) ** 0.5 for d in range(1, 11)}

# ---- samples: quantity and price (thousands) of each supplier's line items


def samples(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(F.col("l_suppkey").alias("run_id"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), F.col("l_returnflag").alias("chain"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))


SAMPLES_SQL = "samples AS (SELECT l_suppkey AS run_id, l_quantity AS a, l_extendedprice / 1000 AS b, l_returnflag AS chain, l_orderkey AS o, l_linenumber AS l FROM lineitem)"
MOMENTS_SQL = """mom AS (SELECT run_id, 'a' AS i, 'a' AS j, avg(a) AS mi, avg(a) AS mj, covar_samp(a, a) AS c, 1.0 AS k FROM samples GROUP BY 1
UNION ALL SELECT run_id, 'a', 'b', avg(a), avg(b), covar_samp(a, b), corr(a, b) FROM samples GROUP BY 1 UNION ALL SELECT run_id, 'b', 'b', avg(b), avg(b), covar_samp(b, b), 1.0 FROM samples GROUP BY 1)"""


def moments(spark, sf):
    return A.sample_moments(samples(spark, sf), ["run_id"], ["a", "b"])


@query(f"WITH {SAMPLES_SQL}, {MOMENTS_SQL} SELECT run_id, i, j, {sq('mi')} AS mean_i, {sq('mj')} AS mean_j, {sq('c')} AS cov FROM mom")
def sample_moments(spark, sf):
    return moments(spark, sf).select("run_id", "i", "j", *sigs("mean_i", "mean_j", "cov"))


@query(f"WITH {SAMPLES_SQL}, {MOMENTS_SQL} SELECT run_id, i, j, {r('k')} AS corr FROM mom")
def correlation_matrix(spark, sf):
    return moments(spark, sf).select("run_id", "i", "j", F.round("corr", 6).alias("corr"))


@query(f"WITH {SAMPLES_SQL}, {MOMENTS_SQL} SELECT i, j, {r('avg(k)')} AS mean, {r('stddev_samp(k)')} AS std, CASE WHEN i = j THEN 1.0::DOUBLE ELSE {sq('avg(k) / nullif(stddev_samp(k), 0)')} END AS boosted FROM mom GROUP BY i, j")
def correlation_across_runs(spark, sf):
    d = A.correlation_across_runs(moments(spark, sf))
    return d.select("i", "j", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.when(F.col("i") == F.col("j"), 1.0).otherwise(sig("boosted")).alias("boosted"))


STATS_SQL = "st AS (SELECT run_id, avg(ln(a)) AS ml, stddev_samp(ln(a)) AS sl, avg(b) AS mb, stddev_samp(b) AS sb FROM samples GROUP BY 1), lg AS (SELECT run_id, 'log' AS kind, ml AS m, sl AS s FROM st UNION ALL SELECT run_id, 'none', mb, sb FROM st)"


def gaussians(spark, sf):
    d = samples(spark, sf).groupBy("run_id").agg(F.avg(F.ln("a")).alias("ml"), F.stddev_samp(F.ln("a")).alias("sl"), F.avg("b").alias("mb"), F.stddev_samp("b").alias("sb"))
    rows = F.array(F.struct(F.lit("log").alias("kind"), F.col("ml").alias("mu"), F.col("sl").alias("sd")), F.struct(F.lit("none").alias("kind"), F.col("mb").alias("mu"), F.col("sb").alias("sd")))
    return d.select("run_id", F.explode(rows).alias("g")).select("run_id", "g.*")


@query(f"WITH {SAMPLES_SQL}, {STATS_SQL} SELECT run_id, kind, {sq(f'''CASE WHEN kind = 'log' THEN exp(m - {CHI[2]!r} * s) ELSE m - {CHI[2]!r} * s END''')} AS low, {sq(f'''CASE WHEN kind = 'log' THEN exp(m + {CHI[2]!r} * s) ELSE m + {CHI[2]!r} * s END''')} AS high FROM lg")
def error_bounds(spark, sf):
    return A.error_bounds(gaussians(spark, sf), "mu", "sd", 2, F.col("kind")).select("run_id", "kind", *sigs("low", "high"))


@query(f"""WITH {SAMPLES_SQL}, {STATS_SQL} SELECT run_id, kind, {sq("CASE WHEN kind = 'log' THEN exp(m + s * s / 2) ELSE m END")} AS m, {sq("CASE WHEN kind = 'log' THEN sqrt((exp(s * s) - 1) * exp(2 * m + s * s)) ELSE s END")} AS s,
{sq("CASE WHEN kind = 'log' THEN exp(m - 2 * s) ELSE m - 2 * s END")} AS low, {sq("CASE WHEN kind = 'log' THEN exp(m + 2 * s) ELSE m + 2 * s END")} AS high FROM lg""")
def mean_std_transformed(spark, sf):
    return A.mean_std_transformed(gaussians(spark, sf), "mu", "sd", F.col("kind"), 2.0).select("run_id", "kind", *sigs("m", "s", "low", "high"))


@query(f"""WITH {SAMPLES_SQL} SELECT run_id, {sq('exp(avg(ln(a / b)))')} AS mean, {sq('exp(avg(ln(a / b)) - stddev_pop(ln(a / b)))')} AS low, {sq('exp(avg(ln(a / b)) + stddev_pop(ln(a / b)))')} AS high FROM samples WHERE a > 0 AND b > 0 GROUP BY 1""")
def geo_mean_dev(spark, sf):
    return A.geo_mean_dev(samples(spark, sf), ["run_id"], F.col("a") / F.col("b")).select("run_id", *sigs("mean", "low", "high"))


@query("""WITH o AS (SELECT o_custkey AS meas_id, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS f FROM orders GROUP BY 1 HAVING min(o_totalprice) < max(o_totalprice))
SELECT meas_id, CAST(printf('%.5e', abs(0.5 * (ln(lo) + ln(hi)) * abs(hi - lo) / (abs(ln(hi) - ln(lo)) / """ + repr(CHI[4]) + """ * f)) * 1.000000000001) AS DOUBLE) AS sensitivity FROM o""")
def sensitivity(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("meas_id")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.avg("o_totalprice").alias("f")).filter("lo < hi")
    return A.sensitivity(o.withColumn("f_lo", F.col("lo")).withColumn("f_hi", F.col("hi"))).select("meas_id", sig("sensitivity").alias("sensitivity"))


@query(f"WITH {BLOCKS_SQL} SELECT seg_pos, pt, min(u) AS low, max(u) AS high, count(*) AS runs FROM blocks GROUP BY 1, 2")
def envelope(spark, sf):
    return A.envelope(blocks(spark, sf), ["seg_pos", "pt"], "u")


@query(f"""WITH {SAMPLES_SQL}, c AS (SELECT run_id, chain, avg(a) AS m, var_samp(a) AS v, count(*) AS n FROM samples GROUP BY 1, 2)
SELECT run_id, {r('sqrt((avg(n) - 1) / avg(n) + var_samp(m) / nullif(avg(v), 0))')} AS r_hat FROM c GROUP BY 1""")
def chain_diagnostics(spark, sf):
    return A.chain_diagnostics(samples(spark, sf), ["run_id"], "chain", "a").select("run_id", F.round("r_hat", 6).alias("r_hat"))


@query(f"""WITH {SAMPLES_SQL}, d AS (SELECT run_id, a - avg(a) OVER (PARTITION BY run_id) AS d, row_number() OVER (PARTITION BY run_id ORDER BY o, l, a) AS k FROM samples),
s AS (SELECT x.run_id, y.k - x.k AS lag, sum(x.d * y.d) AS c FROM d x JOIN d y ON y.run_id = x.run_id AND y.k - x.k BETWEEN 1 AND 60 GROUP BY 1, 2),
v AS (SELECT run_id, count(*) AS n, sum(d * d) AS v FROM d GROUP BY 1), e AS (SELECT s.run_id, coalesce(min(lag) FILTER (NOT c > 0), 61) AS stop FROM s GROUP BY 1)
SELECT v.run_id, {sq('any_value(n) / (1 + 2 * coalesce(sum(c / nullif(v, 0)) FILTER (lag < stop), 0))')} AS ess FROM v LEFT JOIN e ON e.run_id = v.run_id LEFT JOIN s ON s.run_id = v.run_id GROUP BY 1""")
def effective_sample_size(spark, sf):
    """SQL sums up to 60 lags; a chain of these samples has its first correlation that isn't positive long before."""
    d = A.effective_sample_size(samples(spark, sf).withColumn("ord", F.struct("o", "l", "a")), ["run_id"], "ord", "a")
    return d.select("run_id", sig("ess").alias("ess"))


# ---- priors and updates

BOUNDS_SQL = "bnd AS (SELECT o_custkey AS set_id, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CASE WHEN o_custkey % 2 = 0 THEN 'log' ELSE 'none' END AS kind FROM orders GROUP BY 1)"


def bounds(spark, sf):
    kind = F.when(F.col("set_id") % 2 == 0, "log").otherwise("none")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("set_id")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return o.withColumn("kind", kind).withColumn("guess", F.lit(None).cast("double"))


@query(f"""WITH {BOUNDS_SQL}, g AS (SELECT *, CASE WHEN kind = 'log' THEN ln(lo) ELSE lo END AS a, CASE WHEN kind = 'log' THEN ln(hi) ELSE hi END AS b FROM bnd)
SELECT set_id, kind, {sq('0.5 * (a + b)')} AS m, {sq(f'greatest(abs(b - 0.5 * (a + b)), abs(0.5 * (a + b) - a)) / {CHI[3]!r}')} AS s FROM g WHERE lo < hi""")
def prior_from_bounds(spark, sf):
    return P.prior_from_bounds(bounds(spark, sf).filter("lo < hi"), 3).select("set_id", "kind", *sigs("m", "s"))


@query(f"WITH {BOUNDS_SQL} SELECT set_id, {sq('''CASE WHEN kind = 'log' THEN ln(lo) ELSE lo END''')} AS inner_, {sq('lo')} AS back FROM bnd")
def transform_params(spark, sf):
    d = bounds(spark, sf).withColumn("inner_", P.transform_params(F.col("lo"), F.col("kind")))
    return d.withColumn("back", P.transform_params(F.col("inner_"), F.col("kind"), True)).select("set_id", *sigs("inner_", "back"))


DERIVED_SQL = """v AS (SELECT s_suppkey AS set_id, CASE WHEN s_nationkey < 10 THEN 1.5 ELSE s_acctbal END AS balance, CAST(s_nationkey AS DOUBLE) AS nation, CASE WHEN s_nationkey < 5 THEN 7.0 END AS held FROM supplier),
w AS (SELECT *, coalesce(held, balance) AS same FROM v)"""


@query(f"""WITH {DERIVED_SQL} SELECT set_id, n.name, CAST(CASE n.name WHEN 'balance' THEN balance WHEN 'nation' THEN nation WHEN 'same' THEN same WHEN 'copy' THEN nation WHEN 'sum' THEN same + nation ELSE 2 * (same + nation) END AS DOUBLE) AS value
FROM w, (VALUES ('balance'), ('nation'), ('same'), ('copy'), ('sum'), ('twice')) n(name)""")
def derived_parameters(spark, sf):
    """An alias, a copy, a sum of both and a rule on that, with base values and the alias overridden in some sets."""
    s = table(spark, sf, "supplier")
    base = F.explode(F.array(F.struct(F.lit("balance").alias("name"), F.col("s_acctbal").alias("value")), F.struct(F.lit("nation").alias("name"), F.col("s_nationkey").cast("double").alias("value")))).alias("p")
    one = lambda name, value, below: s.filter(F.col("s_nationkey") < below).select(F.col("s_suppkey").alias("set_id"), F.lit(name).alias("name"), F.lit(value).alias("value"))
    rules = {"same": "balance", "copy": lambda get: get("nation"), "sum": lambda get: get("same") + get("copy"), "twice": lambda get: 2 * get("sum")}
    return P.derived_parameters(s.select(F.col("s_suppkey").alias("set_id"), base).select("set_id", "p.*"), one("balance", 1.5, 10).unionByName(one("same", 7.0, 5)), rules)


@query(f"WITH {BOUNDS_SQL} SELECT set_id, {sq('sqrt(lo)')} AS inner_, {sq('lo')} AS back FROM bnd")
def transform_pairs(spark, sf):
    """A transformation of the user's own, by name."""
    pairs = {"root": (F.sqrt, lambda x: x * x)}
    d = bounds(spark, sf).withColumn("kind", F.lit("root")).withColumn("inner_", P.transform_params(F.col("lo"), F.col("kind"), pairs=pairs))
    return d.withColumn("back", P.transform_params(F.col("inner_"), F.col("kind"), True, pairs)).select("set_id", *sigs("inner_", "back"))


F4 = (1e6 / 100.0) ** 0.25
CHAIN_SQL = f"""ch AS (SELECT set_id, greatest(lo / {F4!r}, 100.0) AS a, least(hi * {F4!r}, 1e6) AS b FROM bnd),
c2 AS (SELECT *, CASE WHEN a = 100.0 AND b < a * {F4!r} * {F4!r} THEN a * {F4!r} * {F4!r} ELSE b END AS b2, CASE WHEN NOT (a = 100.0 AND b < a * {F4!r} * {F4!r}) AND b = 1e6 AND a > b / ({F4!r} * {F4!r}) THEN b / ({F4!r} * {F4!r}) ELSE a END AS a2 FROM ch)"""


@query(f"WITH {BOUNDS_SQL}, {CHAIN_SQL} SELECT set_id, {sq('a2')} AS lo, {sq('b2')} AS hi FROM c2")
def prior_chain(spark, sf):
    lo, hi = P.prior_chain(F.col("lo"), F.col("hi"), 100.0, 1e6)
    return bounds(spark, sf).select("set_id", sig(lo).alias("lo"), sig(hi).alias("hi"))


def natural(spark, sf):
    """Q and r of each supplier's samples as Gaussians, in closed form for two parameters."""
    m = samples(spark, sf).groupBy("run_id").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.covar_samp("a", "a").alias("aa"), F.covar_samp("a", "b").alias("ab"), F.covar_samp("b", "b").alias("bb"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    m = m.withColumn("det", det).filter("det > 0")
    cell = lambda i, j, v: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("q"))
    qs = [cell(0, 0, F.col("bb") / F.col("det")), cell(0, 1, -F.col("ab") / F.col("det")), cell(1, 0, -F.col("ab") / F.col("det")), cell(1, 1, F.col("aa") / F.col("det"))]
    q = m.select("run_id", F.explode(F.array(*qs)).alias("c")).select("run_id", "c.*")
    ra = (F.col("bb") * F.col("ma") - F.col("ab") * F.col("mb")) / F.col("det")
    rb = (-F.col("ab") * F.col("ma") + F.col("aa") * F.col("mb")) / F.col("det")
    rs = [F.struct(F.lit(0).alias("i"), ra.alias("r")), F.struct(F.lit(1).alias("i"), rb.alias("r"))]
    return q, m.select("run_id", F.explode(F.array(*rs)).alias("c")).select("run_id", "c.*")


NODES_SQL = f"""n2 AS (SELECT run_id, avg(a) AS ma, avg(b) AS mb, covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(b, b) AS bb FROM samples GROUP BY 1 HAVING covar_samp(a, a) * covar_samp(b, b) - pow(covar_samp(a, b), 2) > 0)"""


@query(f"WITH {SAMPLES_SQL}, {NODES_SQL} SELECT run_id, CAST(i AS INTEGER) AS i, CAST(200 AS BIGINT) AS draws, true AS mean_ok, true AS spread_ok, true AS inside FROM n2, (VALUES (0), (1)) d(i)")
def prior_draws(spark, sf):
    """Draws of hashed normals: their mean within six standard errors, their spread within a third, and all inside the ellipsoid's box."""
    q, rr = natural(spark, sf)
    white = staged(P.whitening(q, rr), "whitening")
    drawn = P.prior_draws(white, 200, 1)
    scale = white.groupBy("run_id", "i").agg(F.first("mean_i").alias("mean"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("s"), (F.first("bound") * F.sum(F.abs("m"))).alias("far"))
    seen = drawn.groupBy("run_id", "i").agg(F.count(F.lit(1)).alias("draws"), F.avg("value").alias("avg"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    d = seen.join(scale.hint("merge"), ["run_id", "i"]).select(  # a row per run and parameter on either side: draws are many more than the whitening that they are estimated by
        "run_id", "i", "draws", (F.abs(F.col("avg") - F.col("mean")) <= 6 * F.col("s") / 200**0.5).alias("mean_ok"), (F.col("std") / F.col("s")).between(2 / 3, 4 / 3).alias("spread_ok"),
        (F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low")) <= F.col("far") * 1.000001).alias("inside"),
    )
    return d.select("run_id", F.col("i").cast("int").alias("i"), "draws", "mean_ok", "spread_ok", "inside")


@query(f"""WITH {SAMPLES_SQL}, {NODES_SQL} SELECT run_id, kind, {sq('ma')} AS centre_a, {sq('mb')} AS centre_b, {sq(f'2 * {CHI[2] ** 2!r} * aa')} AS aa, {sq(f'2 * {CHI[2] ** 2!r} * bb')} AS bb, round({CHI[2] ** 2!r}, 6) AS nearest, round({CHI[2] ** 2!r}, 6) AS farthest, CAST(4 AS BIGINT) AS n
FROM n2, (VALUES ('semiaxis'), ('face')) k(kind)""")
def confidence_nodes(spark, sf):
    """What doesn't depend on the signs of eigenvectors: centre, scatter (twice chi-squared times the covariance) and each node's squared Mahalanobis distance."""
    q, rr = natural(spark, sf)
    white = staged(P.whitening(q, rr), "whitening")
    nodes = P.confidence_nodes(white, 2)
    mean = white.select("run_id", "i", "mean_i").distinct()
    d = nodes.join(mean, ["run_id", "i"]).groupBy("run_id", "kind", "node").agg(*[F.max(F.when(F.col("i") == k, F.col("value") - F.col("mean_i"))).alias(f"d{k}") for k in (0, 1)], *[F.max(F.when(F.col("i") == k, F.col("mean_i"))).alias(f"m{k}") for k in (0, 1)])
    wide = q.groupBy("run_id").agg(*[F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("q"))).alias(f"q{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1))])
    far = F.col("q00") * F.col("d0") * F.col("d0") + 2 * F.col("q01") * F.col("d0") * F.col("d1") + F.col("q11") * F.col("d1") * F.col("d1")
    per = d.join(wide, "run_id").withColumn("far", far).groupBy("run_id", "kind").agg(
        F.avg(F.col("m0") + F.col("d0")).alias("centre_a"), F.avg(F.col("m1") + F.col("d1")).alias("centre_b"), F.sum(F.col("d0") * F.col("d0")).alias("aa"), F.sum(F.col("d1") * F.col("d1")).alias("bb"),
        F.round(F.min("far"), 6).alias("nearest"), F.round(F.max("far"), 6).alias("farthest"), F.count(F.lit(1)).alias("n"),
    )
    return per.select("run_id", "kind", *sigs("centre_a", "centre_b", "aa", "bb"), "nearest", "farthest", "n")


def _linear(p):
    if p["s_acctbal"] < 0:
        raise ValueError("no solution")
    return {"sum": p["s_acctbal"] + p["s_nationkey"], "scaled": 2 * p["s_acctbal"]}


def _sweep(spark, sf):
    s = table(spark, sf, "supplier")
    rows = F.array(F.struct(F.lit("s_acctbal").alias("name"), F.col("s_acctbal").alias("value")), F.struct(F.lit("s_nationkey").alias("name"), F.col("s_nationkey").cast("double").alias("value")))
    sets = s.select(F.col("s_suppkey").alias("set_id"), F.explode(rows).alias("p")).select("set_id", "p.*")
    return sets, P.sweep_features(sets, ["set_id"], ["s_acctbal", "s_nationkey"], _linear)


SWEEP_SQL = """sw AS (SELECT s_suppkey AS set_id, 'sum' AS feature, s_acctbal + s_nationkey AS value FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT s_suppkey, 'scaled', 2 * s_acctbal FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT s_suppkey, 'failed', NULL FROM supplier WHERE s_acctbal < 0)"""


@query(f"WITH {SWEEP_SQL} SELECT set_id, feature, {r('value')} AS value FROM sw")
def sweep_features(spark, sf):
    return _sweep(spark, sf)[1].select("set_id", "feature", F.round("value", 6).alias("value"))


def _simulate(p):
    if p["s_acctbal"] < 0:
        raise ValueError("no solution")
    return [p["s_acctbal"], p["s_nationkey"]]


@query("""SELECT s_suppkey AS set_id, n.name AS feature, round(CASE n.k WHEN 0 THEN s_acctbal + s_nationkey WHEN 1 THEN s_acctbal - s_nationkey ELSE greatest(s_acctbal, s_nationkey) END, 6) + 0 AS value
FROM supplier, (VALUES (0, 'the sum'), (1, 'the difference'), (2, 'largest')) n(k, name) WHERE s_acctbal >= 0 UNION ALL SELECT s_suppkey, 'failed', NULL FROM supplier WHERE s_acctbal < 0""")
def sweep_extractors(spark, sf):
    """One simulation per set, two extractors on what it returns, and names to display."""
    sets, _ = _sweep(spark, sf)
    extractors = [lambda x: {"sum": x[0] + x[1], "difference": x[0] - x[1]}, lambda x: {"largest": max(x)}]
    d = P.sweep_features(sets, ["set_id"], ["s_acctbal", "s_nationkey"], _simulate, extractors)
    names = spark.createDataFrame([("sum", "the sum"), ("difference", "the difference")], "feature string, display string")
    return P.named_features(d, F.broadcast(names)).select("set_id", F.col("display").alias("feature"), F.round("value", 6).alias("value"))


DISC_SQL = "ds AS (SELECT set_id, ln(sqrt(sum(pow(value * w / m - w, 2)))) AS d FROM sw JOIN (VALUES ('sum', 5000.0, 1.0), ('scaled', 9000.0, 0.5)) x(f, m, w) ON x.f = feature GROUP BY 1)"


def _discrepancies(spark, sf):
    measured = spark.createDataFrame([("sum", 5000.0, 1.0), ("scaled", 9000.0, 0.5)], "feature string, value double, weight double")
    sets, found = _sweep(spark, sf)
    return sets, found, P.feature_discrepancy(found, F.broadcast(measured), ["set_id"])


@query(f"WITH {SWEEP_SQL}, {DISC_SQL} SELECT set_id, {r('d')} AS discrepancy FROM ds")
def feature_discrepancy(spark, sf):
    return _discrepancies(spark, sf)[2].select("set_id", F.round("discrepancy", 6).alias("discrepancy"))


@query(f"""WITH {SWEEP_SQL}, {DISC_SQL}, k AS (SELECT s.s_nationkey AS nation, d.set_id, row_number() OVER (PARTITION BY s.s_nationkey ORDER BY d, set_id) AS k, count(*) OVER (PARTITION BY s.s_nationkey) AS n FROM ds d JOIN supplier s ON s.s_suppkey = d.set_id)
SELECT nation, set_id FROM k WHERE k <= greatest(1, floor(n * 0.5))""")
def abc_accept(spark, sf):
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("set_id"), F.col("s_nationkey").alias("nation"))
    return P.abc_accept(_discrepancies(spark, sf)[2].join(nation, "set_id"), ["nation"], 0.5, ["set_id"]).select("nation", "set_id")


@query(f"""WITH {SWEEP_SQL}, {DISC_SQL} SELECT s_suppkey AS set_id, 'parameter' AS kind, n.name, {r("CASE n.name WHEN 's_acctbal' THEN s_acctbal ELSE s_nationkey END")} AS value FROM supplier, (VALUES ('s_acctbal'), ('s_nationkey')) n(name)
UNION ALL SELECT set_id, 'feature', feature, {r('value')} FROM sw UNION ALL SELECT set_id, 'discrepancy', 'log norm', {r('d')} FROM ds""")
def evaluation_log(spark, sf):
    d = P.evaluation_log(*_discrepancies(spark, sf), ["set_id"])
    return d.select("set_id", "kind", "name", F.round("value", 6).alias("value"))


@query(f"""WITH {SAMPLES_SQL}, m AS (SELECT run_id, avg(a) AS ma, avg(b) AS mb, covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(b, b) AS bb FROM samples GROUP BY 1),
h AS (SELECT *, aa * bb - ab * ab AS det FROM m), q AS (SELECT run_id, bb / det AS q00, -ab / det AS q01, aa / det AS q11, (bb * ma - ab * mb) / det AS r0, (aa * mb - ab * ma) / det AS r1 FROM h WHERE det > 0)
SELECT run_id, v.what, CAST(v.i AS INTEGER) AS i, CAST(v.j AS INTEGER) AS j, {sq("CASE v.k WHEN 0 THEN 0.6 * q00 + 0.4 * 0.01 WHEN 1 THEN 0.6 * q01 WHEN 2 THEN 0.6 * q11 + 0.4 * 0.02 WHEN 3 THEN 0.6 * r0 + 0.4 * 0.1 WHEN 4 THEN 0.6 * r1 + 0.4 * 0.2 WHEN 5 THEN 0.6 * (q00 - 0.01) WHEN 6 THEN 0.6 * q01 WHEN 7 THEN 0.6 * (q11 - 0.02) WHEN 8 THEN 0.6 * (r0 - 0.1) ELSE 0.6 * (r1 - 0.2) END")} AS value
FROM q, (VALUES (0, 'Q', 0, 0), (1, 'Q', 0, 1), (1, 'Q', 1, 0), (2, 'Q', 1, 1), (3, 'r', 0, 0), (4, 'r', 1, 0), (5, 'site Q', 0, 0), (6, 'site Q', 0, 1), (6, 'site Q', 1, 0), (7, 'site Q', 1, 1), (8, 'site r', 0, 0), (9, 'site r', 1, 0)) v(k, what, i, j)""")
def ep_site_update(spark, sf):
    """One update of every supplier's run from the same prior with an empty site, dampening 0.4."""
    m = samples(spark, sf).groupBy("run_id").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.covar_samp("a", "a").alias("aa"), F.covar_samp("a", "b").alias("ab"), F.covar_samp("b", "b").alias("bb"))
    one = staged(m.filter(F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab") > 0), "gaussians")  # a row per run, from which all else follows
    cells = lambda *rows: one.select("run_id", F.explode(F.array(*rows)).alias("c")).select("run_id", "c.*")
    cell = lambda i, j, **values: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[(F.col(v) if isinstance(v, str) else F.lit(v)).alias(k) for k, v in values.items()])
    found = cells(cell(0, 0, mean_i="ma", cov="aa"), cell(0, 1, mean_i="ma", cov="ab"), cell(1, 1, mean_i="mb", cov="bb"))
    prior_q = cells(cell(0, 0, q=0.01), cell(0, 1, q=0.0), cell(1, 0, q=0.0), cell(1, 1, q=0.02))
    prior_r = cells(cell(0, 0, r=0.1), cell(1, 0, r=0.2)).drop("j")
    d = P.ep_site_update(found, prior_q, prior_r, None, None, 0.4)
    return d.select("run_id", "what", "i", "j", sig("value").alias("value"))


@query(f"WITH {SAMPLES_SQL}, {NODES_SQL} SELECT run_id, CAST(6 AS BIGINT) AS n, true AS symmetric, true AS definite, true AS narrower FROM n2")
def ep_loop(spark, sf):
    """Two parameters per supplier, two features, two passes; the model returns the parameters.

    Of Gaussians and a model without noise it is known that precision stays symmetric and positive definite, and that the volume shrinks.
    """
    q, rr = natural(spark, sf)
    q, rr = staged(q, "prior"), staged(rr, "prior")
    measured = spark.createDataFrame([("first", 25.0, 1.0), ("second", 30.0, 1.0)], "feature string, value double, weight double")

    def simulate(draws):
        return draws.select("run_id", "draw", F.when(F.col("i") == 0, "first").otherwise("second").alias("feature"), "value")

    found = P.ep_loop(q, rr, measured, ["first", "second"], simulate, 2, 200, 0.25)
    at = lambda name, i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j) & (F.col("what") == "Q"), F.col(name)))
    det = lambda name: at(name, 0, 0) * at(name, 1, 1) - at(name, 0, 1) * at(name, 1, 0)
    both = found.join(q.select("run_id", "i", "j", F.lit("Q").alias("what"), "q"), ["run_id", "what", "i", "j"], "left")
    return both.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), (F.abs(at("value", 0, 1) - at("value", 1, 0)) <= 1e-9 * F.abs(at("value", 0, 1)) + 1e-12).alias("symmetric"),
        ((at("value", 0, 0) > 0) & (det("value") > 0)).alias("definite"), (det("value") > det("q")).alias("narrower"),
    )


SITES_SQL = """m AS (SELECT run_id, chain AS feature, avg(a) AS ma, avg(b) AS mb, covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(b, b) AS bb FROM samples GROUP BY 1, 2 HAVING covar_samp(a, a) * covar_samp(b, b) - pow(covar_samp(a, b), 2) > 1e-6 * covar_samp(a, a) * covar_samp(b, b))"""


def _sites(spark, sf):
    """Precision and its product with the mean of each run and feature: suppliers and return flags."""
    m = samples(spark, sf).groupBy("run_id", F.col("chain").alias("feature")).agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.covar_samp("a", "a").alias("aa"), F.covar_samp("a", "b").alias("ab"), F.covar_samp("b", "b").alias("bb"))
    m = staged(m.withColumn("det", F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")).filter(F.col("det") > 1e-6 * F.col("aa") * F.col("bb")), "gaussians")
    inverse = {(0, 0): F.col("bb") / F.col("det"), (0, 1): -F.col("ab") / F.col("det"), (1, 0): -F.col("ab") / F.col("det"), (1, 1): F.col("aa") / F.col("det")}
    rows = lambda *cells: m.select("run_id", "feature", F.explode(F.array(*cells)).alias("c")).select("run_id", "feature", "c.*")
    q = rows(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("q")) for (i, j), v in inverse.items()])
    r_ = rows(*[F.struct(F.lit(i).alias("i"), (inverse[i, 0] * F.col("ma") + inverse[i, 1] * F.col("mb")).alias("r")) for i in (0, 1)])
    return q, r_


@query(f"""WITH {SAMPLES_SQL}, {SITES_SQL} SELECT run_id, feature, CAST(d.i AS INTEGER) AS i, {sq('CASE d.i WHEN 0 THEN ma ELSE mb END')} AS mean, {sq('sqrt(CASE d.i WHEN 0 THEN aa ELSE bb END)')} AS std,
  {sq(f'CASE d.i WHEN 0 THEN ma - {CHI[2]!r} * sqrt(aa) ELSE exp((mb - {CHI[2]!r} * sqrt(bb)) / 1) END')} AS lower, {sq('CASE d.i WHEN 0 THEN ma ELSE exp(mb) END')} AS guess FROM m, (VALUES (0), (1)) d(i)""")
def site_report(spark, sf):
    """Mean, deviation, guess and lower bound of each run's features, the second parameter on a logarithmic scale."""
    d = P.site_report(*_sites(spark, sf), 2, ["run_id", "feature"], ["none", "log"])
    return d.select("run_id", "feature", "i", *sigs("mean", "std", "lower", "guess"))


@query(f"""WITH {SAMPLES_SQL}, {SITES_SQL} SELECT run_id, feature, CAST(d.i AS INTEGER) AS i, CAST(d.j AS INTEGER) AS j, {sq('CASE d.i + d.j WHEN 0 THEN aa WHEN 1 THEN ab ELSE bb END')} AS covariance,
  {r('CASE WHEN d.i = d.j THEN 1 ELSE ab / sqrt(aa) / sqrt(bb) END')} AS correlation FROM m, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(i, j)""")
def site_matrices(spark, sf):
    """Covariance and correlation of each run's features."""
    d = P.site_matrices(_sites(spark, sf)[0], 2, ["run_id", "feature"])
    return d.select("run_id", "feature", "i", "j", sig("covariance").alias("covariance"), F.round("correlation", 6).alias("correlation"))


@query(f"""WITH o AS (SELECT o_custkey AS run_id, max(o_totalprice) AS e, min(o_totalprice) AS v FROM orders GROUP BY 1) SELECT run_id, {r('abs(ln(e) - ln(v)) / abs(ln(e))')} AS deviation FROM o""")
def verify_recovery(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.max("o_totalprice").alias("e"), F.min("o_totalprice").alias("v"))
    return o.select("run_id", F.round(P.verify_recovery(F.col("e"), F.col("v")), 6).alias("deviation"))


CURVE_SQL = """kn AS (SELECT meas_id, seg_pos AS x, ln(u1) AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY meas_id) AS n, lead(seg_pos) OVER w AS x1, lead(ln(u1)) OVER w AS y1,
  lag(seg_pos) OVER w AS x_, lag(ln(u1)) OVER w AS y_ FROM ends WHERE u1 > 0 WINDOW w AS (PARTITION BY meas_id ORDER BY seg_pos)),
sw AS (SELECT meas_id, CAST(0 AS BIGINT) AS i, n, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS d FROM kn WHERE i = 0
  UNION ALL SELECT k.meas_id, k.i, k.n, (x1 - x) / (2 * (x1 - x_) - (x - x_) * c), (6 * ((y1 - y) / (x1 - x) - (y - y_) / (x - x_)) - (x - x_) * d) / (2 * (x1 - x_) - (x - x_) * c)
  FROM sw JOIN kn k ON k.meas_id = sw.meas_id AND k.i = sw.i + 1 WHERE k.i < k.n - 1),
bk AS (SELECT DISTINCT meas_id, n - 1 AS i, CAST(0 AS DOUBLE) AS m FROM kn WHERE n > 1
  UNION ALL SELECT s.meas_id, s.i, CASE WHEN s.i = 0 THEN 0 ELSE s.d - s.c * b.m END FROM bk b JOIN sw s ON s.meas_id = b.meas_id AND s.i = b.i - 1)"""


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, {ENDS_SQL.format(src='blocks')}, {CURVE_SQL}
SELECT a.meas_id, CAST(a.x AS INTEGER) AS seg_pos, CAST(k AS INTEGER) AS k, {sq('a.x + k / 10 * (a.x1 - a.x)')} AS x,
  {sq('exp((1 - k / 10) * a.y + k / 10 * a.y1 + ((pow(1 - k / 10, 3) - (1 - k / 10)) * m0.m + (pow(k / 10, 3) - k / 10) * m1.m) * pow(a.x1 - a.x, 2) / 6)')} AS y
FROM kn a JOIN bk m0 ON m0.meas_id = a.meas_id AND m0.i = a.i JOIN bk m1 ON m1.meas_id = a.meas_id AND m1.i = a.i + 1, (SELECT unnest(range(0, 11)) AS k)""")
def param_curve(spark, sf):
    d = P.param_curve(S.segment_ends(blocks(spark, sf)), ["meas_id"], "seg_pos", "u1", 11, True)
    return d.select("meas_id", F.col("x0").cast("int").alias("seg_pos"), "k", *sigs("x", "y"))


@query(f"""WITH {BLOCKS_SQL}, {ENDS_SQL.format(src='blocks')} SELECT meas_id, CAST(row_number() OVER (PARTITION BY meas_id ORDER BY seg_pos) - 1 AS INTEGER) AS place, CAST(seg_pos AS INTEGER) AS x,
  CASE WHEN seg_pos % 5 <> 2 THEN {sq('ln(u1)')} END AS y, CASE WHEN seg_pos % 5 <> 2 THEN {sq('ln(u1) - ln(0.9 * u1)')} END AS down, CASE WHEN seg_pos % 5 <> 2 THEN {sq('ln(1.2 * u1) - ln(u1)')} END AS up, seg_pos % 5 = 2 AS missing FROM ends""")
def param_points(spark, sf):
    """The points of a curve with asymmetric bounds; places without a value are reported."""
    ends = S.segment_ends(blocks(spark, sf)).withColumn("y", F.when(F.col("seg_pos") % 5 != 2, F.col("u1"))).withColumn("lo", 0.9 * F.col("u1")).withColumn("hi", 1.2 * F.col("u1"))
    d = P.param_points(ends, ["meas_id"], "seg_pos", "y", "lo", "hi", True)
    kept = lambda c: F.when(~F.col("missing"), sig(c)).alias(c)
    return d.select("meas_id", "place", F.col("x").cast("int").alias("x"), kept("y"), kept("down"), kept("up"), "missing")


@query(f"WITH {RAW_SQL} SELECT meas_id, count(*) AS n, true AS mean_ok, true AS spread_ok, true AS again FROM raw GROUP BY 1")
def add_noise(spark, sf):
    """Hashed noise: mean and largest within bounds of a normal's, the spread within a half where there are 100 points, and the same when made again."""
    raw = raw_points(spark, sf)
    noisy = lambda name: P.add_noise(raw, "u", 0.01, 5, ["meas_id", "pt"]).select("meas_id", "pt", F.col("u").alias(name))
    d = raw.select("meas_id", "pt", "u").join(noisy("a"), ["meas_id", "pt"]).join(noisy("b").repartition(7, "pt"), ["meas_id", "pt"]).withColumn("e", F.col("a") - F.col("u"))
    n = F.count(F.lit(1))
    return d.groupBy("meas_id").agg(
        n.alias("n"), ((F.abs(F.avg("e")) <= 0.06 / F.sqrt(n)) & (F.max(F.abs("e")) <= 0.07)).alias("mean_ok"),
        ((n < 100) | (F.stddev_pop("e")).between(0.005, 0.015)).alias("spread_ok"), F.bool_and(F.col("a") == F.col("b")).alias("again"),
    )


def _ratio_sql(parts, x: str) -> str:
    poly = lambda cs: " + ".join(f"{c!r}::DOUBLE * pow({x}, {k})" for k, c in enumerate(cs))
    return f"(({poly(parts[0])}) / ({poly(parts[1])}))"


def normal_quantile_sql(p: str) -> str:
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    tails = f"CASE WHEN {p} < 0.5 THEN -1 ELSE 1 END * CASE WHEN {r} <= 5 THEN {_ratio_sql(D.MIDDLE, f'({r} - 1.6)')} ELSE {_ratio_sql(D.TAIL, f'({r} - 5)')} END"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {_ratio_sql(D.CENTRE, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} ELSE {tails} END"


def normal_probability_sql(z: str) -> str:
    return f"(0.5 + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: {z} * coalesce(list_product(list_transform(range(1, k + 1), lambda j: {z} * {z} / (2 * j + 1))), 1))))"


INTERVAL_SQL = f"""o AS (SELECT o_custkey AS set_id, avg(o_totalprice) / 1e5 AS a, max(o_totalprice) / 1e5 AS b FROM orders GROUP BY 1), e AS (SELECT *, unnest([0.025, 0.975])::DOUBLE AS p, unnest([0, 1]) AS side FROM o),
u AS (SELECT *, {normal_quantile_sql('p')} AS z, {normal_probability_sql('(-1.0)')} + p * ({normal_probability_sql('(0.5)')} - {normal_probability_sql('(-1.0)')}) AS w FROM e),
v AS (SELECT set_id, side, CASE set_id % 5 WHEN 0 THEN a + b * z WHEN 1 THEN a + p * (b - a) WHEN 2 THEN exp(a + 0.1 * z)
  WHEN 3 THEN CASE WHEN p * (b + 1) < a THEN sqrt(p * (b + 1) * a) ELSE b + 1 - sqrt((1 - p) * (b + 1) * (b + 1 - a)) END ELSE a + b * ({normal_quantile_sql('w')}) END AS x FROM u)"""


@query(f"WITH {INTERVAL_SQL} SELECT l.set_id, {sq('l.x')} AS low, {sq('h.x')} AS high FROM v l JOIN v h ON h.set_id = l.set_id AND l.side = 0 AND h.side = 1")
def uncertainty_interval(spark, sf):
    """Central intervals of five named distributions, by set."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("set_id")).agg((F.avg("o_totalprice") / 1e5).alias("a"), (F.max("o_totalprice") / 1e5).alias("b"))
    a, b = F.col("a"), F.col("b")
    given = {"normal": [a, b], "uniform": [a, b], "lognormal": [a, F.lit(0.1)], "triangular": [F.lit(0.0), a, b + 1], "truncated normal": [a, b, a - b, a + 0.5 * b]}
    at = F.col("set_id") % 5
    pick = lambda values: F.element_at(F.array(*values), (at + 1).cast("int"))
    d = o.select("set_id", pick([F.lit(k) for k in given]).alias("kind"), pick([F.array(*v) for v in given.values()]).alias("arguments"))
    low, high = P.uncertainty_interval(F.col("kind"), F.col("arguments"))
    return d.select("set_id", sig(low).alias("low"), sig(high).alias("high"))


@query("SELECT o_custkey AS set_id, v.name, CASE WHEN v.name = 'c' THEN round(max(o_totalprice), 2) + 0 END AS kept, true AS inside FROM orders, (VALUES ('a'), ('b'), ('c')) v(name) GROUP BY o_custkey, v.name")
def parameter_noise(spark, sf):
    """Draws of two named distributions in place of values, and a value without one."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("set_id")).agg(F.max("o_totalprice").alias("value"))
    sets = o.withColumn("name", F.explode(F.array(*[F.lit(n) for n in "abc"])))
    laws = spark.createDataFrame([("a", "triangular", [1.0, 1.5, 3.0]), ("b", "truncated normal", [0.0, 1.0, -0.5, 2.0])], "name string, kind string, arguments array<double>")
    d = P.parameter_noise(sets, laws, 7)
    inside = F.when(F.col("name") == "a", F.col("value").between(1, 3)).when(F.col("name") == "b", F.col("value").between(-0.5, 2)).otherwise(F.lit(True))
    return d.select("set_id", "name", F.when(F.col("name") == "c", F.round("value", 2) + 0).alias("kept"), inside.alias("inside"))


@query(f"WITH {BLOCKS_SQL}, {ENDS_SQL.format(src='blocks')} SELECT e.meas_id, e.seg_pos, {sq('o.u1 / 500 * 30000')} AS concentration FROM ends e JOIN ends o ON o.meas_id = e.meas_id AND o.seg_pos = 0 WHERE e.seg_pos >= 1")
def initial_soc(spark, sf):
    ends = S.segment_ends(blocks(spark, sf))
    ocv = ends.select("meas_id", F.col("seg_pos").alias("source_index"), F.col("seg_pos").alias("pos"), (F.col("u1") / 500).alias("soc"))
    d = initial_concentration(ends.filter("seg_pos >= 1"), ocv, "soc", 30000.0)
    return d.select("meas_id", "seg_pos", sig("concentration").alias("concentration"))



@query(f"""WITH {BLOCKS_SQL}, {ENDS_SQL.format(src='blocks')} SELECT meas_id, '{{"current_input":[' || string_agg('"Step ' || seg_pos || '"', ',' ORDER BY seg_pos) || '],"experiment_features":[' || string_agg(CAST(CAST(round(u1 * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY seg_pos) || '],"optimizer_settings":{{"iterations":4.0,"seed":0.0}}}}' AS json FROM ends GROUP BY 1""")
def optimizer_input(spark, sf):
    segs = S.segment_ends(blocks(spark, sf)).withColumn("text", F.concat(F.lit("Step "), F.col("seg_pos").cast("string"))).withColumn("feature", F.round(F.col("u1") * 100).cast("long"))
    return P.optimizer_input(segs, {"iterations": 4, "seed": 0})


# ---- scalar formulas

GAMMA_SQL = "0.0789207 / (g - 0.08048093)"


@query("WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount + 0.2 AS g FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity, " + r(GAMMA_SQL) + " AS a FROM l")
def ocv_a_from_gamma(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(O.ocv_a_from_gamma(F.col("l_discount") + 0.2), 6).alias("a"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, " + r("0.1 + l_discount * (0.9 - 0.1)") + " AS soc FROM lineitem")
def soc_adjust(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(O.soc_adjust(F.col("l_discount"), 0.1, 0.9), 6).alias("soc"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, " + r("0.95 - 1.2 * l_discount") + " AS soc FROM lineitem")
def soc_other(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(O.soc_other(F.col("l_discount"), 0.95, 1.2), 6).alias("soc"))


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, {r('least(u, 490) / 500', 7)} AS soc FROM raw")
def soc_from_ocv(spark, sf):
    """The voltage of a known SOC gives back that SOC."""
    positive, negative = (lambda s: 4.2 - 0.8 * s), (lambda s: 0.1 + 0.6 * F.exp(-(1 - s)))
    d = raw_points(spark, sf).withColumn("s", F.least("u", F.lit(490.0)) / 500)
    return d.withColumn("v", positive(F.col("s")) - negative(F.col("s"))).select("meas_id", "pt", F.round(O.soc_from_ocv(F.col("v"), positive, negative), 7).alias("soc"))


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, {r('CASE WHEN x >= 0 AND x < 0.3 THEN (2.0 * x + 1.0) * x + 3.0 WHEN x >= 0.3 AND x < 0.9 THEN (0.5 * x + 1.0) * x + 3.1 END + 0.05 * tanh(20 * (x - 0.5))')} AS y FROM (SELECT *, u / 500 AS x FROM raw)")
def piecewise_curve(spark, sf):
    x = F.col("u") / 500
    y = O.piecewise_curve(x, [(0.0, 0.3, [2.0, 1.0, 3.0]), (0.3, 0.9, [0.5, 1.0, 3.1])], [(0.05, 20.0, 0.5)])
    return raw_points(spark, sf).select("meas_id", "pt", F.round(y, 6).alias("y"))


@query("SELECT p_partkey, CAST(printf('%.5e', 0.6 * p_size * 1e-6 * 0.1 * 0.05 * p_retailprice * 96485.33212331001 * 1.000000000001) AS DOUBLE) AS capacity FROM part")
def cell_capacity(spark, sf):
    c = O.cell_capacity(F.lit(0.6), F.col("p_size") * 1e-6, F.lit(0.1), F.lit(0.05), F.col("p_retailprice"))
    return table(spark, sf, "part").select("p_partkey", sig(c).alias("capacity"))


@query(f"SELECT p_partkey, {sq('2e-6 * pow(1000, 0.5) * pow(p_retailprice, 0.5) * pow(30000 - p_retailprice, 0.5)')} AS i0, {sq('0.5 * 2e-6 * pow(1000, -0.5) * pow(p_retailprice, 0.5) * pow(30000 - p_retailprice, 0.5)')} AS di0 FROM part")
def exchange_current(spark, sf):
    args = (F.lit(2e-6), F.lit(1000.0), F.col("p_retailprice"), F.lit(30000.0))
    return table(spark, sf, "part").select("p_partkey", sig(O.exchange_current(*args)).alias("i0"), sig(O.exchange_current_d(*args)).alias("di0"))


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, {r('0.5 + 0.2 * sin(2 * pi() * 1e-5 * t) + 0.1 * sin(2 * pi() * 3e-5 * t)')} AS signal FROM raw")
def excitation_signal(spark, sf):
    return raw_points(spark, sf).select("meas_id", "pt", F.round(O.excitation_signal(F.col("t"), 0.5, [(0.2, 1e-5), (0.1, 3e-5)]), 6).alias("signal"))


SCALE = 4 / pi * (1 / 30000 / (96485.33212331001 * 0.01)) ** 2
DIFF_SQL = f"""{ENDS_SQL.format(src='blocks')}, dl AS (SELECT *, lead(u1) OVER (PARTITION BY meas_id ORDER BY seg_pos) - u1 AS d_us, u1 - u0 AS d_ut, t1 - t0 AS tau FROM ends),
dd AS (SELECT *, i_mean * tau / 1e9 AS d_soc FROM dl WHERE d_us <> 0 AND d_ut <> 0 AND abs(i_mean) > 1e-6 AND tau > 0 AND abs(d_us) > 0.001 AND abs(d_ut) > 0.001)"""


def _pulses(spark, sf):
    d = S.delta_static(S.segment_ends(blocks(spark, sf)), "u1").withColumnRenamed("delta", "d_us")
    d = d.withColumn("d_ut", F.col("u1") - F.col("u0")).withColumn("tau", F.col("t1") - F.col("t0"))
    return d.filter("d_us <> 0 and d_ut <> 0 and abs(i_mean) > 1e-6 and tau > 0 and abs(d_us) > 0.001 and abs(d_ut) > 0.001").withColumn("d_soc", F.col("i_mean") * F.col("tau") / 1e9)


def _d_sql(us, ut):
    return sq(f"{SCALE!r} * i_mean * i_mean * tau / (d_soc * d_soc) * pow(({us}) / ({ut}), 2)")


@query(f"""WITH {BLOCKS_SQL}, {DIFF_SQL} SELECT meas_id, seg_pos, {_d_sql('d_us', 'd_ut')} AS d, {_d_sql('sign(d_us) * (abs(d_us) - 0.0005)', 'sign(d_ut) * (abs(d_ut) + 0.0005)')} AS low, {_d_sql('sign(d_us) * (abs(d_us) + 0.0005)', 'sign(d_ut) * (abs(d_ut) - 0.0005)')} AS high FROM dd""")
def gitt_diffusivity(spark, sf):
    low, high = O.gitt_bounds(F.col("d_us"), F.col("d_ut"), 0.0005)
    value = lambda us, ut: O.gitt_diffusivity(F.col("i_mean"), F.col("tau"), F.col("d_soc"), us, ut, SCALE)
    return _pulses(spark, sf).select(*S.SEG, sig(value(F.col("d_us"), F.col("d_ut"))).alias("d"), sig(value(*low)).alias("low"), sig(value(*high)).alias("high"))


@query(f"WITH {BLOCKS_SQL}, {DIFF_SQL} SELECT meas_id, seg_pos, {sq(f'{SCALE!r} * i_mean * i_mean * pow((d_us / d_soc) / (d_ut / sqrt(tau)), 2)')} AS d FROM dd")
def gitt_diffusivity_slope(spark, sf):
    value = O.gitt_diffusivity_slope(F.col("i_mean"), F.col("d_us") / F.col("d_soc"), F.col("d_ut") / F.sqrt("tau"), SCALE)
    return _pulses(spark, sf).select(*S.SEG, sig(value).alias("d"))


RT = 8.31446261815324 * 298.15 / (96485.33212331001 * 0.01)


@query(f"SELECT p_partkey, {sq(f'{RT!r} * (1 / (1.0 * 1e5 * 1e-4 * p_retailprice) + 1 / (1.0 * 2e5 * 5e-5 * p_size))')} AS resistance FROM part WHERE p_size > 0")
def joint_resistance(spark, sf):
    d = table(spark, sf, "part").filter("p_size > 0")
    return d.select("p_partkey", sig(O.joint_resistance([(1.0, 1e5, 1e-4, F.col("p_retailprice")), (1.0, 2e5, 5e-5, F.col("p_size"))], 0.01)).alias("resistance"))


@query(f"""WITH {SPECTRA_SQL} SELECT meas_id, pt, {sq('sqrt(re * re + im * im)')} AS size, {r('atan2(im, re)')} AS phase, {sq('re * re - im * im')} AS square_re, {sq('2 * re * im')} AS square_im, {sq('re / (re * re + im * im)')} AS inverse_re, {sq('-im / (re * re + im * im)')} AS inverse_im FROM spectra""")
def complex_arith(spark, sf):
    z = C.Z(F.col("re"), F.col("im"))
    square, inverse = z * z, C.real(1.0) / z
    return spectra(spark, sf).select("meas_id", "pt", sig(z.abs()).alias("size"), F.round(z.phase(), 6).alias("phase"), sig(square.re).alias("square_re"), sig(square.im).alias("square_im"), sig(inverse.re).alias("inverse_re"), sig(inverse.im).alias("inverse_im"))


def _circuits_sql() -> str:
    """Each circuit written out once more, in complex numbers as structs."""
    real_, cap, coil = (lambda x: f"{{'re': {x}, 'im': 0.0::DOUBLE}}"), (lambda x: f"{{'re': 0.0::DOUBLE, 'im': -1 / (w * {x})}}"), (lambda x: f"{{'re': 0.0::DOUBLE, 'im': w * {x}}}")
    inv = lambda z: f"list_transform([{z}], lambda x: {{'re': x.re / (x.re * x.re + x.im * x.im), 'im': -x.im / (x.re * x.re + x.im * x.im)}})[1]"
    ser = lambda *zs: f"list_reduce([{', '.join(zs)}], lambda x, y: {{'re': x.re + y.re, 'im': x.im + y.im}})"
    par = lambda *zs: inv(ser(*map(inv, zs)))
    # sigma coth(x (1 + j)) / (half (1 + j)), with coth = (sinh 2x - j sin 2x) / (cosh 2x - cos 2x)
    wo = "{'re': sg / (2 * h * (cosh(2 * x) - cos(2 * x))) * (sinh(2 * x) - sin(2 * x)), 'im': sg / (2 * h * (cosh(2 * x) - cos(2 * x))) * (-sin(2 * x) - sinh(2 * x))}"
    face = par(cap("1e-3"), ser(real_("rc"), wo))
    al = par(cap("0.05"), real_("3.0"))
    cpe = "{'re': pow(0.4 * w, -0.85) * cos(0.425 * pi()), 'im': -pow(0.4 * w, -0.85) * sin(0.425 * pi())}"
    return ", ".join(f"('{n}', {z})" for n, z in {
        "two_rc": ser(real_("0.1"), par(real_("rc"), cap("1e-3")), par(real_("2.0"), cap("1e-2"))),
        "debye": ser(par(real_("0.5"), cap("1e-4")), cap("1e-3")), "debye_variant": par(ser(real_("0.5"), cap("1e-3")), cap("1e-4")),
        "randles": ser(real_("0.6"), face), "randles_blocked": ser(real_("0.6"), face, cap("0.5")),
        "randles_serial": ser(real_("0.6"), par(cap("1e-3"), real_("rc")), wo, cpe),
        "scr": ser(real_("0.5"), par(cap("1e-4"), ser(real_("0.3"), face))),
        "scrf": ser(real_("0.5"), par(cap("1e-4"), ser(real_("0.3"), par(cap("2e-3"), ser(face, real_("0.7")))))),
        "aluminium": ser(real_("0.2"), par(cap("1e-3"), real_("rc"), ser(coil("0.1"), real_("2.0"))), al),
        "aluminium_variant": ser(real_("0.2"), par(cap("1e-3"), ser(real_("rc"), par(coil("0.1"), real_("2.0")))), al),
    }.items())


@query(f"""WITH e AS (SELECT p_partkey, k, pow(10.0, k - 2) AS w, 1.0 + p_size AS rc, p_retailprice / 1000 AS sg, 0.8 * sqrt(pow(10.0, k - 2) / 2) AS x, sqrt(pow(10.0, k - 2) / 2) AS h FROM part, (SELECT unnest(range(0, 5)) AS k))
SELECT p_partkey, c.circuit, CAST(k AS INTEGER) AS k, {sq('c.z.re')} AS re, {sq('c.z.im')} AS im FROM e, LATERAL (VALUES {_circuits_sql()}) c(circuit, z)""")
def circuit_impedance(spark, sf):
    """All known circuits, as a table of trees, with each part's parameters at five frequencies, in one job."""
    fixed = {"R_0": 0.1, "R_2": 2.0, "C_1": 1e-3, "C_2": 1e-2, "R_B": 0.5, "R_U": 0.6, "R_C": 0.3, "R_F": 0.7, "R_s": 0.2, "R_3": 3.0, "C_D": 1e-4, "C_DL": 1e-3, "C_F": 2e-3, "C_X": 0.5, "C": 0.05, "L_1": 0.1, "tau": 0.8, "Q_X": 0.4, "alpha": 0.85}
    trees = C.named_circuits("Wo")
    nodes = spark.createDataFrame([r for n, t in trees.items() for r in C.tree_rows(n, t)], C.NODES)
    own = {"R_1": 1.0 + F.col("p_size"), "R_CT": 1.0 + F.col("p_size"), "sigma": F.col("p_retailprice") / 1000}
    params = F.create_map(*[x for k, v in (fixed | own).items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # fifty rows come of each
    p = parts.select("p_partkey", params.alias("params"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    p = p.withColumn("omega", F.pow(F.lit(10.0), F.col("k") - 2)).withColumn("circuit", F.explode(F.array(*[F.lit(n) for n in trees])))
    return C.circuit_impedance(p, nodes).select("p_partkey", "circuit", "k", sig("re").alias("re"), sig("im").alias("im"))


TWO_RC_SQL = """lw AS (SELECT *, ln(f) AS lf FROM spectra), mu AS (SELECT avg(lf) AS m, stddev_samp(lf) AS s FROM (SELECT DISTINCT pt, lf FROM lw)),
th AS (SELECT CAST(k AS INTEGER) AS k, 0.0 AS t0, -0.5 + 0.25 * k AS t1, 0.3 AS t2, -1.0 AS a, 1.0 AS b FROM (SELECT unnest(range(0, 4)) AS k)),
md AS (SELECT l.meas_id, th.k, l.re, l.im, exp(t0) AS rt, exp(-exp(t1)) AS r1, exp(-exp(t2)) AS r2, lf - (s * a + m) AS x1, lf - (s * b + m) AS x2 FROM lw l, mu, th),
er AS (SELECT meas_id, k, count(*) AS n, sum(pow(re - rt * (1 - r1 - r2 + r1 / 2 * (1 - tanh(x1)) + r2 / 2 * (1 - tanh(x2))), 2) + pow(im - rt * (r1 / 2 / cosh(x1) + r2 / 2 / cosh(x2)), 2)) AS e FROM md GROUP BY 1, 2)"""


@query(f"WITH {SPECTRA_SQL}, {TWO_RC_SQL} SELECT meas_id, k, {r('-ln(e / (2 * n))')} AS discrepancy, {r('-n * (1 + ln(pi() / n * e))', 4)} AS log_likelihood FROM er")
def two_rc_discrepancy(spark, sf):
    from voltlake.operators.spectra import two_rc_discrepancy as op

    theta = [(0.0, -0.5 + 0.25 * k, 0.3, -1.0, 1.0) for k in range(4)]
    d = op(spectra(spark, sf), theta)
    return d.select("meas_id", "k", F.round("discrepancy", 6).alias("discrepancy"), F.round("log_likelihood", 4).alias("log_likelihood"))


@query(f"""WITH {SPECTRA_SQL}, n AS (SELECT meas_id, arg_min(re, (abs(f - 1.0), pt)) AS r0 FROM spectra GROUP BY 1) SELECT s.meas_id, s.pt, {sq('r0 + 2.0 / (1 + pow(f * 0.1, 2))')} AS re, {sq('-2.0 * f * 0.1 / (1 + pow(f * 0.1, 2))')} AS im FROM spectra s JOIN n ON n.meas_id = s.meas_id""")
def drt_semicircle(spark, sf):
    s = spectra(spark, sf)
    anchor = lookup_nearest(s, S.MEAS, "f", 1.0, ["re"]).withColumnRenamed("re", "r0")
    z = C.drt_semicircle(F.col("r0"), F.lit(2.0), F.col("f") * 0.1)
    return s.join(anchor, "meas_id").select("meas_id", "pt", sig(z.re).alias("re"), sig(z.im).alias("im"))


@query(f"""WITH {BLOCKS_SQL}, w AS (SELECT *, (t - first_value(t) OVER w) / nullif(last_value(t) OVER w - first_value(t) OVER w, 0) AS x FROM blocks WINDOW w AS (PARTITION BY meas_id, seg_pos ORDER BY pt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT meas_id, seg_pos, pt, {r('1 - (0.1 + (1 - x) * 0.8)')} AS electrode_soc FROM w""")
def soc_assign(spark, sf):
    d = S.soc_assign(blocks(spark, sf), "t", 0.1, 0.9, complement=True)
    return d.select(*S.SEG, "pt", F.round("electrode_soc", 6).alias("electrode_soc"))


GRIDS_SQL = "g AS (SELECT meas_id, min(f) AS a, max(f) AS b FROM spectra GROUP BY 1)"


@query(f"WITH {SPECTRA_SQL}, {GRIDS_SQL} SELECT meas_id, CAST(k AS INTEGER) AS k, {sq('exp(ln(a) + (ln(b) - ln(a)) * k / 12)')} AS x FROM g, (SELECT unnest(range(0, 13)) AS k)")
def log_grid(spark, sf):
    from voltlake.operators.spectra import grid

    g = spectra(spark, sf).groupBy("meas_id").agg(F.min("f").alias("a"), F.max("f").alias("b"))
    return grid(g, "a", "b", 13, True).select("meas_id", "k", sig("x").alias("x"))


@query(f"WITH {SPECTRA_SQL}, {GRIDS_SQL} SELECT meas_id, CAST(k AS INTEGER) AS k, {sq('a + (b - a) * k / 12')} AS x FROM g, (SELECT unnest(range(0, 13)) AS k)")
def lin_grid(spark, sf):
    from voltlake.operators.spectra import grid

    g = spectra(spark, sf).groupBy("meas_id").agg(F.min("f").alias("a"), F.max("f").alias("b"))
    return grid(g, "a", "b", 13, False).select("meas_id", "k", sig("x").alias("x"))


# ---- sources and sinks


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, {r('t * 3600', 3)} AS t, {r('u * 1e-3', 8)} AS u FROM raw")
def unit_scale(spark, sf):
    d = M.unit_scale(raw_points(spark, sf).drop("raw"), {"t": "t [h]", "u": "U [mV]"})
    return d.select("meas_id", "pt", F.round("t", 3).alias("t"), F.round("U", 8).alias("u"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 2) + 0 END AS number, CASE WHEN event_id % 7 = 0 THEN event_type END AS text FROM events")
def src_decimal(spark, sf):
    written = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(",")))
    d = table(spark, sf, "events").select("event_id", written.alias("cell")).withColumn("number", M.decimal(F.col("cell")))
    return d.select("event_id", "number", F.when(F.col("number").isNull(), F.col("cell")).alias("text"))


def _event_files(spark, sf):
    """Events as tab-separated files with a header line each, a folder for each event type, and the folder's path."""
    path = new_path(spark, "instrument")
    events = table(spark, sf, "events").select("event_id", "user_id", F.col("value").cast("string").alias("value"), "event_type", F.col("event_type").alias("device"))
    events.write.option("header", True).option("sep", "\t").partitionBy("device").csv(path)
    return path


EVENT_COLUMNS = {0: "event_id", 1: "user_id", 2: "U [mV]", 3: "state"}


@query("SELECT event_id, event_type AS folder, CAST(0 AS INTEGER) AS number, round(value / 1000, 8) + 0 AS u FROM events")
def src_multi_file(spark, sf):
    """All files of a tree in one read; what a file's name says becomes columns, here its folder and the number behind ``part-``."""
    path = _event_files(spark, sf)
    d = M.read_instrument_csv(spark, path, EVENT_COLUMNS, skip=1)
    number = M.file_number(F.regexp_extract("file", "part-([0-9]+)", 1), 5)
    folder = F.regexp_extract("file", "device=([^/]+)/", 1)
    return d.select(F.col("event_id").cast("long").alias("event_id"), folder.alias("folder"), F.when(number >= 0, 0).otherwise(1).alias("number"), F.round("U", 8).alias("u"))


@query("SELECT event_id, state FROM (SELECT event_id, event_type AS state, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS k FROM events) WHERE k <= 3")
def src_line_limit(spark, sf):
    """At most three data lines of each file: files of 500 events, as their ids number them, read with the limit."""
    path = new_path(spark, "limited")
    events = table(spark, sf, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 500).alias("part"))
    events.repartition("part").sortWithinPartitions("part", "event_id").write.option("header", True).option("sep", "\t").partitionBy("part").csv(path)
    d = M.read_instrument_csv(spark, path, {0: "event_id", 1: "state"}, skip=1, limit=3)
    return d.select(F.col("event_id").cast("long").alias("event_id"), F.col("state_text").alias("state"))


@query("SELECT event_id, event_type AS name, CAST(length(event_type) AS INTEGER) AS serial, round(value / 1000, 8) + 0 AS u FROM events WHERE event_type IN ('click', 'error')")
def src_measurement_catalog(spark, sf):
    """The catalog says which files to read, with what columns and unit, and what is known of them."""
    path = _event_files(spark, sf)
    kinds = table(spark, sf, "events").select("event_type").distinct()
    catalog = kinds.select(F.concat(F.lit(f"{path}/device="), "event_type").alias("path"), F.col("event_type").alias("name"), F.length("event_type").alias("serial"))
    d = M.by_catalog(spark, catalog.filter("name in ('click', 'error')"), EVENT_COLUMNS, skip=1)
    return d.select(F.col("event_id").cast("long").alias("event_id"), "name", "serial", F.round("U", 8).alias("u"))


@query(f"WITH {BLOCKS_SQL} SELECT meas_id, seg_pos, pt, {r('t')} AS t, i + 0 AS i, u FROM blocks")
def src_sink_measurement_json(spark, sf):
    """Round trip through nested lists."""
    d = M.from_measurement_json(M.to_measurement_json(blocks(spark, sf)))
    return d.select("meas_id", "seg_pos", "pt", F.round("t", 6).alias("t"), (F.col("i") + 0.0).alias("i"), "u")


def _written(spark, sf):
    path = new_path(spark, "measurement")
    M.write_parquet(blocks(spark, sf), path)
    return path


@query(f"WITH {BLOCKS_SQL} SELECT meas_id, seg_pos, pt, i + 0 AS i, u, state FROM blocks")
def sink_measurement_parquet(spark, sf):
    d, _ = M.read_parquet(spark, _written(spark, sf))
    return d.select("meas_id", "seg_pos", "pt", (F.col("i") + 0.0).alias("i"), "u", "state")


@query(f"WITH {BLOCKS_SQL} SELECT 'state' AS extra, meas_id, seg_pos, pt, i + 0 AS i, u, state FROM blocks WHERE seg_pos = 2")
def src_measurement_parquet(spark, sf):
    """Extra columns are the difference of names; the segment filter reaches the scan."""
    d, extra = M.read_parquet(spark, _written(spark, sf))
    return d.filter("seg_pos = 2").select(F.lit(",".join(extra)).alias("extra"), "meas_id", "seg_pos", "pt", (F.col("i") + 0.0).alias("i"), "u", "state")


@query(f"WITH {BLOCKS_SQL} SELECT meas_id, seg_pos, pt, i + 0 AS i, u, state, true AS own_group FROM blocks")
def sink_segment_groups(spark, sf):
    """A row group for each segment: what is read back, and that there are as many groups as segments."""
    made = M.write_segments(blocks(spark, sf), new_path(spark, "segments"))
    groups = made.agg(F.sum("groups").alias("groups"))
    d = spark.read.parquet(*[r.uri for r in made.select("uri").collect()])
    segments = d.select("meas_id", "seg_pos").distinct().agg(F.count(F.lit(1)).alias("n"))
    same = groups.first().groups == segments.first().n
    return d.select("meas_id", "seg_pos", "pt", (F.col("i") + 0.0).alias("i"), "u", "state", F.lit(same).alias("own_group"))


@query("SELECT event_id, user_id, round(value / 1000, 8) + 0 AS u, event_type AS state FROM events")
def src_instrument_csv(spark, sf):
    """Events written as tab-separated text with one comment line per file, and read as an instrument's file."""
    d = M.read_instrument_csv(spark, _event_files(spark, sf), EVENT_COLUMNS, skip=1)
    return d.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), F.round("U", 8).alias("u"), F.col("state_text").alias("state"))


INSTRUMENT_SQL = f"""{RAW_SQL}, seg AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY meas_id ORDER BY pt) = state THEN 0 ELSE 1 END AS c FROM raw),
num AS (SELECT *, CAST(sum(c) OVER (PARTITION BY meas_id ORDER BY pt ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS seg_pos FROM seg)"""


def _user_files(spark, sf, *columns):
    """Points of each user as a file of its own, in order, all in one folder."""
    path = new_path(spark, "cycler")
    p = raw_points(spark, sf).select("pt", *columns, F.col("meas_id").alias("cell"))
    names = [c for c in p.columns if c not in ("pt", "cell")]
    M.write_lines(p, path, "cell", "pt", ";".join(names), names, ";")
    return path


@query(f"""WITH {INSTRUMENT_SQL} SELECT meas_id, seg_pos, pt, {r('t', 3)} AS t, {r('i', 6)} AS i, {r('-u', 6)} AS u FROM num WHERE seg_pos IN (0, 2, 3)""")
def src_instrument_cycling(spark, sf):
    """One read of cycler files: decimal commas, units, segments by a column's changes, chosen segments, signs by state, flipped voltage."""
    comma = lambda c, k: F.replace((F.col(c) * k).cast("decimal(30,10)").cast("string"), F.lit("."), F.lit(",")).alias(c)
    path = _user_files(spark, sf, comma("t", 1.0), comma("raw", 1000.0), comma("u", 1.0), "state")
    d = M.read_instrument(spark, path, {0: "t [s]", 1: "I [mA]", 2: "U [V]"}, skip=1, delimiter=";", symbol=",", segment_column=3, segments=[0, 2, 3], state_column=3, signs=SIGNS, flip_voltage=True)
    cell = F.regexp_extract("file", "cell=([0-9]+)[.]csv", 1).cast("long")
    return d.select(cell.alias("meas_id"), "seg_pos", "pt", F.round("t", 3).alias("t"), (F.round("i", 6) + 0.0).alias("i"), (F.round("u", 6) + 0.0).alias("u"))


@query(f"""WITH {RAW_SQL} SELECT meas_id, CAST(0 AS INTEGER) AS seg_pos, pt, {r('t + 1', 3)} AS f, {r('-raw.u', 6)} AS re, {r('raw.u / 2', 6)} AS im FROM raw WHERE pt < 20""")
def src_instrument_impedance(spark, sf):
    """One read of impedance files: both parts flipped, the imaginary one back again, at most twenty lines of each."""
    path = _user_files(spark, sf, (F.col("t") + 1).alias("f"), F.col("u").alias("re"), (F.col("u") / 2).alias("im"))
    d = M.read_instrument(spark, path, {0: "f [Hz]", 1: "real [Ω]", 2: "imag [Ω]"}, skip=1, delimiter=";", limit=20, datatype="impedance", flip_voltage=True, flip_imaginary=True)
    cell = F.regexp_extract("file", "cell=([0-9]+)[.]csv", 1).cast("long")
    return d.select(cell.alias("meas_id"), "seg_pos", "pt", F.round("f", 3).alias("f"), (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


@query("SELECT event_id, value AS u, 'event_id' || chr(9) || 'value' AS comment FROM events")
def sink_csv_to_parquet(spark, sf):
    """Plain conversion; the comment lines are a table of their own, read back with the file they stood in."""
    path, out = new_path(spark, "instrument"), new_path(spark, "converted")
    table(spark, sf, "events").select("event_id", "value").write.option("header", True).option("sep", "\t").csv(path)
    M.read_instrument_csv(spark, path, {0: "event_id", 1: "value"}, skip=1).write.parquet(out)
    M.comment_lines(spark, path, 1).write.parquet(out + "-comments")
    comments = spark.read.parquet(out + "-comments").select("file", F.col("line").alias("comment"))
    return spark.read.parquet(out).join(comments, "file").select(F.col("event_id").cast("long").alias("event_id"), F.col("value").alias("u"), "comment")


@query(f"WITH {BLOCKS_SQL}, {ENDS_SQL.format(src='blocks')} SELECT meas_id, CAST(seg_pos AS BIGINT) AS source_index, {r('u0 / 500')} AS soc, {r('u1')} AS ocv FROM ends")
def src_ocv_json(spark, sf):
    ends = S.segment_ends(blocks(spark, sf)).select("meas_id", F.col("seg_pos").alias("source_index"), (F.col("u0") / 500).alias("soc"), F.col("u1").alias("ocv"))
    d = M.from_ocv_json(M.to_ocv_json(ends))
    return d.select("meas_id", "source_index", F.round("soc", 6).alias("soc"), F.round("ocv", 6).alias("ocv"))


def _results(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("name"))
    return o.agg(F.max("o_totalprice").alias("value"), F.min("o_totalprice").alias("lo"), (F.max("o_totalprice") * 2).alias("hi"))


RESULT_SQL = "SELECT o_custkey AS run_id, o_orderpriority AS name, max(o_totalprice) AS value, min(o_totalprice) AS lo, max(o_totalprice) * 2 AS hi FROM orders GROUP BY 1, 2"


@query(RESULT_SQL)
def src_result_json(spark, sf):
    return M.from_result_json(M.to_result_json(_results(spark, sf)))


@query(RESULT_SQL)
def sink_result_json(spark, sf):
    """Written as JSON lines and collected again."""
    path = new_path(spark, "results")
    M.to_result_json(_results(spark, sf)).write.json(path)
    return M.from_result_json(spark.read.schema("run_id long, json string").json(path))


@query(f"WITH {PROTOCOL_SQL} SELECT meas_id, string_agg(text, '|' ORDER BY seg_pos) AS steps FROM protocol GROUP BY 1")
def sink_protocol_json(spark, sf):
    path = new_path(spark, "protocol")
    steps = A.protocol_text(blocks(spark, sf)).groupBy("meas_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", "text"))), lambda x: x["text"]).alias("steps"))
    steps.write.json(path)
    return spark.read.schema("meas_id long, steps array<string>").json(path).select("meas_id", F.array_join("steps", "|").alias("steps"))
