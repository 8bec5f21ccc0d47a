"""Queries of joins and grouped fits, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.operators import fits as X
from voltlake.operators import joins as J
from voltlake.operators import segments as S
from voltlake.plans.segment_queries import COULOMB_SQL, CROSS_SQL, ENDS_SQL
from voltlake.plans.views import BLOCKS_SQL, RAW_SQL, SPECTRA_SQL, blocks, r, raw_points, spectra, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def sig(column):
    """Six significant digits; the nudge keeps exact halves, which engines round differently, from deciding. Null (which is written as a word) stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.format_string("%.5e", c * 1.000000000001).try_cast("double")


def sq(expression: str) -> str:
    return f"CAST(printf('%.5e', CAST({expression} AS DOUBLE) * 1.000000000001) AS DOUBLE)"


ENDS = ENDS_SQL.format(src="blocks")


@query(f"""WITH {BLOCKS_SQL}, {ENDS}, s AS (SELECT *, min(seg_pos) OVER (PARTITION BY meas_id) - 1 AS x FROM ends WHERE seg_pos >= 1)
SELECT s.meas_id, s.seg_pos, {r('e.u1')} AS start FROM s JOIN ends e ON e.meas_id = s.meas_id AND e.seg_pos = s.x""")
def join_source_index(spark, sf):
    ends = S.segment_ends(blocks(spark, sf))
    ocv = ends.select("meas_id", F.col("seg_pos").alias("source_index"), F.col("seg_pos").alias("pos"), "u1")
    return J.join_source_index(ends.filter("seg_pos >= 1"), ocv, "u1").select("meas_id", "seg_pos", F.round("start", 6).alias("start"))


@query(f"""WITH {BLOCKS_SQL}, {ENDS}, l AS (SELECT *, lag(u1) OVER w AS p, lag(i_mean) OVER w AS c FROM ends WINDOW w AS (PARTITION BY meas_id ORDER BY seg_pos))
SELECT meas_id, seg_pos, {r('p')} AS pulse_u1, {r('c')} AS pulse_i_mean, {r('u1')} AS u1 FROM l WHERE seg_pos % 2 = 1""")
def pair_pulse_rest(spark, sf):
    d = J.pair_pulse_rest(S.segment_ends(blocks(spark, sf)), ["u1", "i_mean"])
    return d.select("meas_id", "seg_pos", *[F.round(c, 6).alias(c) for c in ("pulse_u1", "pulse_i_mean", "u1")])


@query("""WITH d AS (SELECT l_suppkey AS meas_id, l_returnflag AS f, l_orderkey * 10 + l_linenumber AS seg_pos, min(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY meas_id, f ORDER BY seg_pos) - 1 AS cycle FROM d),
p AS (SELECT meas_id, cycle, max(v) FILTER (f = 'A') AS charge, max(v) FILTER (f = 'N') AS hold, max(v) FILTER (f = 'R') AS discharge FROM n GROUP BY 1, 2)
SELECT meas_id, CAST(cycle AS INTEGER) AS cycle, charge, hold, discharge FROM p WHERE charge IS NOT NULL AND hold IS NOT NULL AND discharge IS NOT NULL""")
def align_cycles(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("value"))
    lines = lines.select(F.col("l_suppkey").alias("meas_id"), "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seg_pos"), "value")
    of = lambda flag: lines.filter(F.col("l_returnflag") == flag)
    return J.align_cycles(("charge", of("A")), ("hold", of("N")), ("discharge", of("R")))


@query(f"WITH {SPECTRA_SQL} SELECT meas_id, arg_min(pt, (abs(f - 1.0), pt)) AS pt, {r('arg_min(re, (abs(f - 1.0), pt))')} AS re FROM spectra GROUP BY 1")
def lookup_nearest(spark, sf):
    return J.lookup_nearest(spectra(spark, sf), S.MEAS, "f", 1.0, ["pt", "re"]).select("meas_id", F.col("pt").cast("long").alias("pt"), F.round("re", 6).alias("re"))


GRID_SQL = """grid AS (SELECT m.meas_id, g.k, g.k * 250000.0 AS x FROM (SELECT DISTINCT meas_id FROM raw) m, (SELECT unnest(range(0, 12)) AS k) g)"""
INTERP_SQL = """knots AS (SELECT meas_id, x, min(y) AS y FROM {src} GROUP BY 1, 2), seg AS (SELECT meas_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM knots WINDOW w AS (PARTITION BY meas_id ORDER BY x))"""
AT_SQL = "CASE WHEN s.x0 = g.x THEN s.y0 WHEN s.x1 IS NOT NULL THEN s.y0 + (g.x - s.x0) / (s.x1 - s.x0) * (s.y1 - s.y0) END"


@query(f"""WITH {RAW_SQL}, {GRID_SQL}, src AS (SELECT meas_id, t AS x, u AS y FROM raw), {INTERP_SQL.format(src='src')}
SELECT g.meas_id, CAST(g.k AS INTEGER) AS k, {r(AT_SQL)} AS y FROM grid g LEFT JOIN seg s ON s.meas_id = g.meas_id AND s.x0 <= g.x AND (g.x < s.x1 OR s.x1 IS NULL)""")
def join_interp(spark, sf):
    raw = raw_points(spark, sf)
    grid = raw.select("meas_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("x", F.col("k") * 250000.0)
    d = J.join_interp(grid, raw.select("meas_id", F.col("t").alias("x"), F.col("u").alias("y")), S.MEAS)
    return d.select("meas_id", "k", F.round("y", 6).alias("y"))


def base_parameters(spark, sf):
    s = table(spark, sf, "supplier")
    long = F.explode(F.array(F.struct(F.lit("balance").alias("name"), F.col("s_acctbal").alias("value")), F.struct(F.lit("nation").alias("name"), F.col("s_nationkey").cast("double").alias("value")))).alias("p")
    return s.select(F.col("s_suppkey").alias("set_id"), long).select("set_id", "p.*")


@query("""WITH b AS (SELECT s_suppkey AS set_id, 'balance' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier),
f AS (SELECT s_suppkey AS set_id, 'balance' AS name, 1.5 AS value FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT s_suppkey, 'extra', 2.5 FROM supplier WHERE s_nationkey < 5)
SELECT coalesce(b.set_id, f.set_id) AS set_id, coalesce(b.name, f.name) AS name, CAST(coalesce(f.value, b.value) AS DOUBLE) AS value FROM b FULL JOIN f ON b.set_id = f.set_id AND b.name = f.name""")
def param_override(spark, sf):
    s = table(spark, sf, "supplier")
    one = lambda name, value, below: s.filter(F.col("s_nationkey") < below).select(F.col("s_suppkey").alias("set_id"), F.lit(name).alias("name"), F.lit(value).alias("value"))
    return J.param_override(base_parameters(spark, sf), one("balance", 1.5, 10).unionByName(one("extra", 2.5, 5)))


@query("""SELECT s_suppkey AS base_id, CAST(a.k + 3 * b.k AS INTEGER) AS set_id, n.name, CASE WHEN n.name = 'rate' THEN a.v ELSE b.v END AS value
FROM supplier, (VALUES (0, 0.9), (1, 1.0), (2, 1.1)) a(k, v), (VALUES (0, 10.0), (1, 20.0)) b(k, v), (VALUES ('rate'), ('depth')) n(name)""")
def param_grid(spark, sf):
    return J.param_grid(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("base_id")), {"rate": [0.9, 1.0, 1.1], "depth": [10.0, 20.0]})


@query("""SELECT s_suppkey AS base_id, CAST(v.k AS INTEGER) AS set_id, n.name, CASE WHEN n.name = v.n THEN v.v WHEN n.name = 's_acctbal' THEN s_acctbal ELSE CAST(s_nationkey AS DOUBLE) END AS value
FROM supplier, (VALUES (0, 's_acctbal', 0.0), (1, 's_acctbal', 5.0), (2, 's_nationkey', 99.0)) v(k, n, v), (VALUES ('s_acctbal'), ('s_nationkey')) n(name)""")
def param_one_at_a_time(spark, sf):
    bases = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("base_id"), "s_acctbal", "s_nationkey")
    return J.param_one_at_a_time(bases, ["s_acctbal", "s_nationkey"], {"s_acctbal": [0.0, 5.0], "s_nationkey": [99.0]})


@query("""SELECT 'r1' AS name UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1""")
def alias_closure(spark, sf):
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nations = table(spark, sf, "nation").select(named("n", "n_nationkey").alias("name"), named("r", "n_regionkey").alias("dep"))
    suppliers = table(spark, sf, "supplier").select(named("s", "s_suppkey").alias("name"), named("n", "s_nationkey").alias("dep"))
    return J.alias_closure(nations.unionByName(suppliers), ["r1"])


@query(f"""WITH {BLOCKS_SQL}, {ENDS} SELECT a.meas_id, n.feature, {r("CASE n.feature WHEN 'u1' THEN a.u1 ELSE a.i_mean END")} AS measured, {r("CASE n.feature WHEN 'u1' THEN b.u1 ELSE b.i_mean END")} AS simulated
FROM ends a JOIN ends b ON b.meas_id = a.meas_id AND b.seg_pos = 1, (VALUES ('u1'), ('i_mean')) n(feature) WHERE a.seg_pos = 0""")
def features_join(spark, sf):
    ends = S.segment_ends(blocks(spark, sf))
    long = lambda k: ends.filter(F.col("seg_pos") == k).select("meas_id", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("value")) for c in ("u1", "i_mean")])).alias("f")).select("meas_id", "f.*")
    return J.features_join(long(0), long(1))


FIRST_RATES = "SELECT g, coalesce(lag(g) OVER (ORDER BY k), g) AS lo, coalesce(lead(g) OVER (ORDER BY k), g) AS hi FROM (SELECT k, 0.2 * pow(250, k / 23) AS g FROM (SELECT unnest(range(0, 24)) AS k))"


def rounds_sql(p: str, src: str, keys: str, x: str, y: str, where: str = "true", first: str = FIRST_RATES, between: str = "lo * pow(hi / lo, {k} / 23)", k: str | None = None) -> str:
    """CTEs up to ``w{p}`` (keys, g, b, c or k, sse, syy): the best of the first values, then three rounds of twenty-four between the best one's neighbours. k: SQL of a slope through the origin."""
    sums = "regr_intercept(y, x) AS b, regr_slope(y, x) AS c, greatest(0, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) AS sse, regr_syy(y, x) AS syy"
    held, enough = "'b': b, 'c': c", "count(*) >= 4 AND regr_sxx(y, x) > 0"
    if k:
        sums = f"{k} AS k, greatest(0, sum(y * y) - 2 * {k} * sum(x * y) + {k} * {k} * sum(x * x)) AS sse, sum(y * y) AS syy"
        held, enough = "'k': k", "count(x) >= 4 AND sum(x * x) > 0"
    out = []
    for n in range(4):
        places = [f"{{'g': {between.format(k=j)}, 'lo': {between.format(k=max(0, j - 1))}, 'hi': {between.format(k=min(23, j + 1))}}}" for j in range(24)]
        both = " AND ".join(f"s.{c.strip()} = w.{c.strip()}" for c in keys.split(","))
        tries = f"SELECT s.*, r.g, r.lo, r.hi FROM {src} s, ({first}) r" if n == 0 else f"SELECT s.*, w.f.g AS g, w.f.lo AS lo, w.f.hi AS hi FROM {src} s JOIN (SELECT {keys}, unnest([{', '.join(places)}]) AS f FROM v{p}{n - 1}) w ON {both}"
        out.append(f"""q{p}{n} AS MATERIALIZED (SELECT {keys}, g, lo, hi, {sums} FROM (SELECT *, {x} AS x, {y} AS y FROM ({tries}) WHERE {where}) GROUP BY {keys}, g, lo, hi HAVING {enough}),
v{p}{n} AS MATERIALIZED (SELECT {keys}, z.* FROM (SELECT {keys}, unnest(list_filter(l, lambda e: e.sse <= m * (1 + 1e-9) + 1e-11 * e.syy)[1:1]) AS z FROM
  (SELECT {keys}, list({{'g': g, 'lo': lo, 'hi': hi, {held}, 'sse': sse, 'syy': syy}} ORDER BY g, lo, hi) AS l, min(sse) AS m FROM q{p}{n} GROUP BY {keys})))""")
    return ", ".join(out) + f", w{p} AS (SELECT * FROM v{p}3)"


def exp_sql(src: str, y: str = "u", p: str = "") -> str:
    """CTEs tau{p} and decay{p} (meas_id, seg_pos, asymptote, amplitude, rate, sse)."""
    fits = rounds_sql(f"e{p}", f"tau{p}", "meas_id, seg_pos, span", "exp(-g * tau / span)", y, "span > 0")
    return f"""tau{p} AS (SELECT *, t - min(t) OVER w AS tau, max(t) OVER w - min(t) OVER w AS span FROM {src} WINDOW w AS (PARTITION BY meas_id, seg_pos)), {fits},
decay{p} AS (SELECT meas_id, seg_pos, b AS asymptote, c AS amplitude, g / span AS rate, sse FROM we{p})"""


EXP = exp_sql("blocks")
#: The same of the current, with names of its own.
EXP_I = exp_sql("blocks", "i", "_i")


def _pass_sql(p: int, src: str) -> str:
    fits = rounds_sql(f"p{p}", f"s{p}", "meas_id, seg_pos, share, t0, span", "exp(-g * (tau - t0) / span)", "v", "span > 0")
    return f"""n{p} AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY meas_id, seg_pos ORDER BY pt) AS k FROM {src} WINDOW w AS (PARTITION BY meas_id, seg_pos)),
s{p} AS (SELECT n{p}.*, s.share, min(tau) OVER w AS t0, max(tau) OVER w - min(tau) OVER w AS span FROM n{p}, (VALUES (1.0::DOUBLE), (0.75), (0.5), (0.25)) s(share) WHERE k > n - ceil(s.share * n) WINDOW w AS (PARTITION BY meas_id, seg_pos, s.share)),
{fits}, f{p} AS (SELECT meas_id, seg_pos, share, t0, b AS asymptote, c * exp(g * t0 / span) AS amplitude, g / span AS rate, c FROM wp{p}),
r{p} AS (SELECT s.meas_id, s.seg_pos, s.share, any_value(f.t0) AS t0, any_value(f.asymptote) AS asymptote, any_value(f.amplitude) AS amplitude, any_value(f.rate) AS rate,
  1 - sum(pow(tau + ln(greatest((v - asymptote) / amplitude, 1e-3)) / rate, 2)) / nullif(regr_sxx(tau, tau), 0) AS r2 FROM s{p} s JOIN f{p} f ON f.meas_id = s.meas_id AND f.seg_pos = s.seg_pos AND f.share = s.share WHERE f.c <> 0 AND s.span > 0 GROUP BY 1, 2, 3),
b{p} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY meas_id, seg_pos ORDER BY r2 >= 0.95 DESC, CASE WHEN r2 >= 0.95 THEN share ELSE r2 END DESC, share DESC) AS o FROM r{p} WHERE r2 IS NOT NULL) WHERE o = 1)"""


DECAYS_SQL = "z0 AS (SELECT meas_id, seg_pos, pt, t - min(t) OVER (PARTITION BY meas_id, seg_pos) AS tau, u AS v FROM blocks), " + _pass_sql(0, "z0") + """,
z1 AS (SELECT z0.meas_id, z0.seg_pos, z0.pt, z0.tau, v - asymptote - amplitude * exp(-rate * tau) AS v FROM z0 JOIN b0 ON b0.meas_id = z0.meas_id AND b0.seg_pos = z0.seg_pos WHERE tau < t0), """ + _pass_sql(1, "z1")


@query(f"""WITH {BLOCKS_SQL}, {DECAYS_SQL}, e AS (SELECT 0 AS pass, * FROM b0 UNION ALL SELECT 1, * FROM b1)
SELECT meas_id, seg_pos, CAST(pass AS INTEGER) AS pass, share, {sq('asymptote')} AS asymptote, {sq('amplitude')} AS amplitude, {sq('rate')} AS rate, {r('r2', 5)} AS r2 FROM e""")
def fit_exp_decays(spark, sf):
    """Decays over the best trailing stretch, then the faster ones on the residual before it."""
    d = X.fit_exp_decays(blocks(spark, sf))
    return d.select(*S.SEG, "pass", "share", *[sig(c).alias(c) for c in ("asymptote", "amplitude", "rate")], F.round("r2", 5).alias("r2"))


#: Every leading stretch is fitted by itself here, and the halving walks over them.
SQRT_SQL = """bl AS (SELECT *, t - min(t) OVER w AS tau, count(*) OVER w AS n FROM blocks WINDOW w AS (PARTITION BY meas_id, seg_pos)),
lead_ AS (SELECT l.*, m.pt + 1 AS m, sqrt(l.tau + {layer}) - sqrt({layer}) AS x FROM bl l JOIN bl m ON m.meas_id = l.meas_id AND m.seg_pos = l.seg_pos AND l.pt <= m.pt),
reg AS (SELECT meas_id, seg_pos, m, regr_intercept(u, x) AS b, regr_slope(u, x) AS c FROM lead_ GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND regr_slope(u, x) <> 0),
rr AS MATERIALIZED (SELECT l.meas_id, l.seg_pos, l.m, any_value(l.n) AS n, any_value(b) AS b, any_value(c) AS c, 1 - sum(pow(pow((u - b) / c + sqrt({layer}), 2) - {layer} - tau, 2)) / nullif(regr_sxx(tau, tau), 0) AS r2
  FROM lead_ l JOIN reg q ON q.meas_id = l.meas_id AND q.seg_pos = l.seg_pos AND q.m = l.m GROUP BY 1, 2, 3 HAVING r2 IS NOT NULL),
walk AS (SELECT s.meas_id, s.seg_pos, s.n, 0 AS d, CAST(0 AS BIGINT) AS k, coalesce(r.r2, -1e300) AS now, r.m AS best, coalesce(r.r2, -1e300) AS most
  FROM (SELECT DISTINCT meas_id, seg_pos, n FROM bl) s LEFT JOIN rr r ON r.meas_id = s.meas_id AND r.seg_pos = s.seg_pos AND r.m = s.n // 2
  UNION ALL
  SELECT meas_id, seg_pos, n, d + 1, 2 * k + CASE WHEN a > b THEN 0 ELSE 1 END, greatest(a, b), CASE WHEN greatest(a, b) >= 0.95 OR greatest(a, b) > most THEN CASE WHEN a > b THEN am ELSE bm END ELSE best END, greatest(most, a, b)
  FROM (SELECT w.*, coalesce(x.r2, -1e300) AS a, x.m AS am, coalesce(y.r2, -1e300) AS b, y.m AS bm FROM walk w
    LEFT JOIN rr x ON x.meas_id = w.meas_id AND x.seg_pos = w.seg_pos AND x.m = (4 * k + 1) * w.n // (4 << d) LEFT JOIN rr y ON y.meas_id = w.meas_id AND y.seg_pos = w.seg_pos AND y.m = (4 * k + 3) * w.n // (4 << d)
    WHERE now < 0.95 AND (k + 1) * w.n // (1 << d) - k * w.n // (1 << d) > 1)),
root AS (SELECT r.meas_id, r.seg_pos, r.m / r.n AS share, r.b, r.c, r.r2 FROM (SELECT meas_id, seg_pos, arg_max(best, d) AS m FROM walk GROUP BY 1, 2) w JOIN rr r ON r.meas_id = w.meas_id AND r.seg_pos = w.seg_pos AND r.m = w.m)"""


@query(f"WITH {BLOCKS_SQL}, {EXP} SELECT meas_id, seg_pos, {sq('asymptote')} AS asymptote, {sq('amplitude')} AS amplitude, {sq('rate')} AS rate, {sq('sse')} AS sse FROM decay")
def fit_exp_decay(spark, sf):
    return X.fit_exp_decay(blocks(spark, sf)).select(*S.SEG, *[sig(c).alias(c) for c in ("asymptote", "amplitude", "rate", "sse")])


@query(f"WITH RECURSIVE {BLOCKS_SQL}, {SQRT_SQL.format(layer='0.0')} SELECT meas_id, seg_pos, CAST(share AS DOUBLE) AS share, {sq('b')} AS b, {sq('c')} AS c, {r('r2', 5)} AS r2 FROM root")
def fit_sqrt(spark, sf):
    return X.fit_sqrt(blocks(spark, sf)).select(*S.SEG, "share", *[sig(c).alias(c) for c in ("b", "c")], F.round("r2", 5).alias("r2"))


@query(f"WITH RECURSIVE {BLOCKS_SQL}, {SQRT_SQL.format(layer='2500.0')} SELECT meas_id, seg_pos, CAST(share AS DOUBLE) AS share, {sq('b')} AS b, {sq('c')} AS c, {r('r2', 5)} AS r2 FROM root")
def fit_sqrt_layered(spark, sf):
    return X.fit_sqrt(blocks(spark, sf), layer=2500.0).select(*S.SEG, "share", *[sig(c).alias(c) for c in ("b", "c")], F.round("r2", 5).alias("r2"))


def power_sql(grid, high: str) -> str:
    first = "SELECT unnest([" + ", ".join(f"{{'g': {g!r}::DOUBLE, 'lo': {grid[max(0, k - 1)]!r}::DOUBLE, 'hi': {grid[min(len(grid) - 1, k + 1)]!r}::DOUBLE}}" for k, g in enumerate(grid)) + "]) AS f"
    fits = rounds_sql("l", "p0", "meas_id, seg_pos", "pow(tau, g)", "y0", "tau > 0", f"SELECT f.g AS g, f.lo AS lo, f.hi AS hi FROM ({first})", "lo + (hi - lo) * ({k} / 23)", f"least(greatest(sum(x * y) / sum(x * x), 0.0), {high})")
    return f"""p0 AS (SELECT *, t - min(t) OVER (PARTITION BY meas_id, seg_pos) AS tau, u - first_value(u) OVER (PARTITION BY meas_id, seg_pos ORDER BY pt) AS y0 FROM blocks), {fits}"""


NARROW, WIDE = [0.5 + 0.05 * k for k in range(13)], [0.1 + 0.145 * k for k in range(21)]
_POWER = "SELECT meas_id, seg_pos, {e} AS exponent, {k} AS k, {l} AS ln_k, {x} AS explained FROM wl".format(
    e=sq("g"), k=sq("k"), l="CASE WHEN k > 0 THEN " + sq("ln(k)") + " END", x=sq("1 - sse / nullif(syy, 0)")
)


def _power(spark, sf, grid, high):
    d = X.fit_power_law(blocks(spark, sf), grid, high)
    return d.select(*S.SEG, *[sig(c).alias(c) for c in ("exponent", "k")], F.when(F.col("k") > 0, sig("ln_k")).alias("ln_k"), sig("explained").alias("explained"))


@query(f"WITH {BLOCKS_SQL}, {power_sql(NARROW, '1e-2')} {_POWER}")
def fit_power_law(spark, sf):
    return _power(spark, sf, NARROW, 1e-2)


@query(f"WITH {BLOCKS_SQL}, {power_sql(WIDE, '1e2')} {_POWER}")
def fit_power_law_wide(spark, sf):
    return _power(spark, sf, WIDE, 1e2)


ALPHAS = [k / 10 for k in range(1, 10)]
BV_FIRST = "SELECT f.g AS g, f.lo AS lo, f.hi AS hi FROM (SELECT unnest([" + ", ".join(f"{{'g': {g!r}::DOUBLE, 'lo': {ALPHAS[max(0, k - 1)]!r}::DOUBLE, 'hi': {ALPHAS[min(8, k + 1)]!r}::DOUBLE}}" for k, g in enumerate(ALPHAS)) + "]) AS f)"
BV_SQL = "b0 AS (SELECT l_suppkey AS meas_id, l_quantity / 51 AS s, l_extendedprice / 1000 AS y0 FROM lineitem), " + rounds_sql("l", "b0", "meas_id", "sqrt(1000) * pow(s, 1 - g) * pow(1 - s, g)", "y0", "s > 0 AND s < 1", BV_FIRST, "lo + (hi - lo) * ({k} / 23)", "sum(x * y) / sum(x * x)")


@query(f"WITH {BV_SQL} SELECT meas_id, {sq('g')} AS alpha, {sq('k')} AS scale FROM wl")
def fit_butler_volmer(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("meas_id"), (F.col("l_quantity") / 51).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    d = X.fit_butler_volmer(lines, S.MEAS, F.col("x"), F.col("y"), ALPHAS)
    return d.select("meas_id", sig("alpha").alias("alpha"), sig("scale").alias("scale"))


@query(f"""WITH {BLOCKS_SQL}, {EXP} SELECT f.meas_id, f.seg_pos, {sq('1 - sum(pow(tau + ln(greatest((u - asymptote) / amplitude, 1e-3)) / rate, 2)) / nullif(regr_sxx(tau, tau), 0)')} AS r2
FROM tau f JOIN decay d ON d.meas_id = f.meas_id AND d.seg_pos = f.seg_pos GROUP BY 1, 2""")
def inverse_axis_r2(spark, sf):
    """Of exponential fits; logarithms' arguments are at least 0.001."""
    points = X.decay_points(blocks(spark, sf), "u")
    d = points.join(X.decays(points), S.SEG)
    back = -F.ln(F.greatest((F.col("u") - F.col("asymptote")) / F.col("amplitude"), F.lit(1e-3))) / F.col("rate")
    return X.inverse_axis_r2(d, S.SEG, F.col("tau"), back).select(*S.SEG, sig("r2").alias("r2"))


@query(f"WITH {BLOCKS_SQL}, {EXP} SELECT f.meas_id, f.seg_pos, f.pt, {r('u')} AS u, {sq('asymptote + amplitude * exp(-rate * tau)')} AS fitted FROM tau f JOIN decay d ON d.meas_id = f.meas_id AND d.seg_pos = f.seg_pos")
def fit_curve_values(spark, sf):
    b = blocks(spark, sf)
    return X.fit_curve_values(b, X.fit_exp_decay(b)).select(*S.SEG, "pt", F.round("u", 6).alias("u"), sig("fitted").alias("fitted"))


@query(f"WITH {BLOCKS_SQL}, {EXP}, {ENDS} SELECT e.meas_id, e.seg_pos, e.n FROM ends e SEMI JOIN decay d ON d.meas_id = e.meas_id AND d.seg_pos = e.seg_pos")
def drop_failed_fits(spark, sf):
    b = blocks(spark, sf)
    return J.drop_failed_fits(S.segment_ends(b), X.fit_exp_decay(b)).select(*S.SEG, "n")


@query(f"WITH RECURSIVE {BLOCKS_SQL}, {SQRT_SQL.format(layer='0.0')} SELECT meas_id, {sq('max(r2)')} AS r2, arg_max(seg_pos, (r2, seg_pos)) AS seg_pos FROM root GROUP BY 1")
def best_candidate(spark, sf):
    best = X.best_candidate(X.fit_sqrt(blocks(spark, sf)), S.MEAS, F.struct("r2", "seg_pos"), ["r2", "seg_pos"])
    return best.select("meas_id", sig("r2").alias("r2"), "seg_pos")


@query(f"""WITH {BLOCKS_SQL}, {EXP}, {EXP_I}, {ENDS}, i AS (SELECT *, coalesce(u0 - lag(u1) OVER (PARTITION BY meas_id ORDER BY seg_pos), 0) AS ir FROM ends)
SELECT i.meas_id, i.seg_pos, {sq('coalesce(d.asymptote, i.u1)')} AS asymptotic_voltage, {r('ir')} AS ir_step, CASE WHEN d.rate IS NOT NULL THEN {sq('d.amplitude')} END AS amplitude, CASE WHEN d.rate IS NOT NULL THEN {sq('d.rate')} END AS rate,
  CASE WHEN c.rate IS NOT NULL THEN {sq('c.asymptote')} END AS i_asymptote, CASE WHEN c.rate IS NOT NULL THEN {sq('c.amplitude')} END AS i_amplitude, CASE WHEN c.rate IS NOT NULL THEN {sq('c.rate')} END AS i_rate
FROM i LEFT JOIN decay d ON d.meas_id = i.meas_id AND d.seg_pos = i.seg_pos LEFT JOIN decay_i c ON c.meas_id = i.meas_id AND c.seg_pos = i.seg_pos""")
def static_features(spark, sf):
    d = X.static_features(blocks(spark, sf))
    kept = lambda c: F.when(F.col(c).isNotNull(), sig(c)).alias(c)
    return d.select(*S.SEG, sig("asymptotic_voltage").alias("asymptotic_voltage"), F.round("ir_step", 6).alias("ir_step"), *[kept(c) for c in ("amplitude", "rate", "i_asymptote", "i_amplitude", "i_rate")])


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, {EXP}, {SQRT_SQL.format(layer='0.0')}, v AS (SELECT d.meas_id, d.seg_pos, unnest([0, 1, 2, 3, 4]) AS k, unnest([asymptote - b, amplitude, 1 / rate, b, 1 / c]) AS value FROM decay d JOIN root s ON s.meas_id = d.meas_id AND s.seg_pos = d.seg_pos)
SELECT meas_id, seg_pos, CAST(5 * seg_pos + k AS INTEGER) AS feature, {sq('value')} AS value FROM v WHERE 5 * seg_pos + k IN (1, 2, 3, 4, 6, 7, 8, 9)""")
def gitt_features(spark, sf):
    return X.gitt_features(blocks(spark, sf), [1, 2, 3, 4, 6, 7, 8, 9]).select(*S.SEG, F.col("feature").cast("int").alias("feature"), sig("value").alias("value"))


@query(f"""WITH {BLOCKS_SQL}, {COULOMB_SQL.format(src='blocks')}, b AS (SELECT *, t - first_value(t) OVER (PARTITION BY meas_id, seg_pos ORDER BY pt) AS s FROM blocks WHERE seg_pos % 2 = 1),
{CROSS_SQL.format(k='meas_id, seg_pos', x='s - 60000', src='b')}, trimmed AS (SELECT b.* FROM b JOIN cross_ c ON b.meas_id = c.meas_id AND b.seg_pos = c.seg_pos WHERE b.pt >= c.pos),
{exp_sql('trimmed')}, {ENDS}, pl AS (SELECT *, lag(i_mean) OVER (PARTITION BY meas_id ORDER BY seg_pos) AS pulse FROM ends),
q_end AS (SELECT meas_id, seg_pos, arg_max(c, pt) AS soc FROM soc GROUP BY 1, 2)
SELECT d.meas_id, d.seg_pos, {sq('q.soc')} AS soc, {sq('d.asymptote')} AS ocv, CASE WHEN pl.pulse >= 0 THEN 'lithiation' ELSE 'delithiation' END AS direction
FROM decay d JOIN q_end q ON q.meas_id = d.meas_id AND q.seg_pos = d.seg_pos JOIN pl ON pl.meas_id = d.meas_id AND pl.seg_pos = d.seg_pos""")
def extract_ocv(spark, sf):
    """SOC and relaxed voltage at every second segment, the first minute-scale stretch of it left out."""
    d = X.extract_ocv(blocks(spark, sf), F.col("seg_pos") % 2 == 1, 60000.0)
    return d.select(*S.SEG, sig("soc").alias("soc"), sig("ocv").alias("ocv"), "direction")


@query("""WITH a AS (SELECT l_suppkey AS meas_id, l_linenumber AS seg_pos, l_quantity AS u FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT meas_id, max(seg_pos) + 1 AS n FROM a GROUP BY 1)
SELECT meas_id, seg_pos, u FROM a UNION ALL SELECT l_suppkey, l_linenumber + coalesce(n.n, 0), l_quantity FROM lineitem LEFT JOIN n ON n.meas_id = l_suppkey WHERE l_returnflag = 'R'""")
def meas_extend(spark, sf):
    lines = table(spark, sf, "lineitem")
    of = lambda flag, extra: lines.filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("meas_id"), F.col("l_linenumber").alias("seg_pos"), F.col("l_quantity").alias("u"), extra)
    return J.meas_extend(of("A", "l_tax"), of("R", "l_discount"))


@query("""SELECT s_suppkey AS base_id, CAST(v.k AS INTEGER) AS set_id, 's_acctbal' AS name, coalesce(v.v, s_acctbal) AS value, v.kind FROM supplier, (VALUES (0, NULL::DOUBLE, 'base'), (0, 1.0, 'single'), (1, 2.0, 'single'), (0, 3.0, 'factorial'), (1, 4.0, 'factorial')) v(k, v, kind)""")
def union_runs(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("base_id"), "s_acctbal")
    base = s.select("base_id", F.lit(0).alias("set_id"), F.lit("s_acctbal").alias("name"), F.col("s_acctbal").alias("value"))
    return J.union_runs({"base": base, "single": J.param_one_at_a_time(s, ["s_acctbal"], {"s_acctbal": [1.0, 2.0]}), "factorial": J.param_grid(s, {"s_acctbal": [3.0, 4.0]})})
