"""Queries of segment statistics, curves and spectra, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltlake.functions import ocv as O
from voltlake.operators import segments as S
from voltlake.operators import statistics as A
from voltlake.plans.fit_queries import INTERP_SQL, sig, sq
from voltlake.plans.segment_queries import COULOMB_SQL, ENDS_SQL
from voltlake.plans.views import BLOCKS_SQL, POINTS_SQL, RAW_SQL, SPECTRA_SQL, blocks, points, r, raw_points, spectra, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def sigs(*columns):
    return [sig(c).alias(c) for c in columns]


#: A plateau model used by the queries (voltage, steepness, share).
PLATEAUS = [(3.9, 0.25, 0.3), (3.7, 0.5, 0.3), (3.4, 0.2, 0.4)]
K = O.slope_unit()


def _u(e):
    return [(f"exp(greatest(least(({e} - {e0}) * {a * K!r}, 700.0), -700.0))", a * K, dx) for e0, a, dx in PLATEAUS]


def soc_sql(e):
    return "(" + " + ".join(f"{dx} / (1 + {x})" for x, _, dx in _u(e)) + ")"


def d1_sql(e):
    return "(" + " + ".join(f"-{dx} * {k!r} * {x} / pow(1 + {x}, 2)" for x, k, dx in _u(e)) + ")"


def d2_sql(e):
    return "(" + " + ".join(f"{dx} * {k * k!r} * {x} * ({x} - 1) / pow(1 + {x}, 3)" for x, k, dx in _u(e)) + ")"


SPAN_SQL = """span AS (SELECT meas_id, seg_pos, max(t) - min(t) AS duration, arg_min(u, pt) AS u_first, arg_max(u, pt) AS u_last, avg(i) AS i_mean, avg(abs(i)) AS i_abs, stddev_pop(u) AS u_std FROM {src} GROUP BY 1, 2)"""
STEP_SQL = "CASE WHEN i_abs < 1e-8 THEN 'Rest' WHEN u_std < 1e-8 THEN 'Hold' WHEN i_mean > 0 THEN 'Discharge' ELSE 'Charge' END"


@query(f"WITH {BLOCKS_SQL} SELECT meas_id, seg_pos, {sq('avg(i)')} AS i_mean, {sq('var_pop(i)')} AS i_var, {sq('avg(u)')} AS u_mean, {sq('var_pop(u)')} AS u_var FROM blocks GROUP BY 1, 2 HAVING count(*) >= 4")
def segment_stats(spark, sf):
    b = blocks(spark, sf)
    full = b.groupBy(*S.SEG).agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").select(*S.SEG)
    return A.segment_stats(b).join(full, S.SEG).select(*S.SEG, *sigs("i_mean", "i_var", "u_mean", "u_var"))


@query(f"WITH {POINTS_SQL}, {SPAN_SQL.format(src='points')} SELECT meas_id, seg_pos, {r('duration')} AS duration, {r('u_first')} AS u_first, {r('u_last')} AS u_last, {r('i_mean')} AS i_mean, {r('i_abs')} AS i_abs FROM span")
def segment_span(spark, sf):
    return A.segment_span(points(spark, sf)).select(*S.SEG, *[F.round(c, 6).alias(c) for c in ("duration", "u_first", "u_last", "i_mean", "i_abs")])


@query(f"""WITH {POINTS_SQL}, {SPAN_SQL.format(src='points')}, {COULOMB_SQL.format(src='points')}, c AS (SELECT meas_id, seg_pos, sum(dq) AS charge FROM q GROUP BY 1, 2)
SELECT s.meas_id, s.seg_pos, {STEP_SQL} AS step, {r('c.charge', 3)} AS charge FROM span s JOIN c ON c.meas_id = s.meas_id AND c.seg_pos = s.seg_pos""")
def protocol_classify(spark, sf):
    """Charge moved and protocol step of every segment."""
    p = points(spark, sf)
    return A.protocol_classify(p).join(A.charge_throughput(p), S.SEG).select(*S.SEG, "step", F.round("charge", 3).alias("charge"))


def digits_sql(x):
    short = f"CAST(printf('%.3e', CAST({x} AS DOUBLE) * 1.000000000001) AS DOUBLE)"
    return f"rtrim(rtrim(printf('%.9f', {short}), '0'), '.')"


_D = " ".join(f"WHEN duration >= {k} THEN {digits_sql(f'duration / {k}.0')} || ' {n}'" for k, n in ((86400, "d"), (3600, "h"), (60, "m")))


PROTOCOL_SQL = f"""{BLOCKS_SQL}, {SPAN_SQL.format(src='blocks')}, s AS (SELECT *, {STEP_SQL} AS step FROM span), protocol AS (
SELECT meas_id, seg_pos, seg_pos || ': ' || CASE step WHEN 'Rest' THEN 'Rest' WHEN 'Hold' THEN 'Hold at ' || {digits_sql('u_last')} || ' V' ELSE step || ' at ' || {digits_sql('abs(i_mean)')} || ' A' END
  || ' for ' || CASE {_D} ELSE {digits_sql('duration')} || ' s' END AS text FROM s)"""


@query(f"WITH {PROTOCOL_SQL} SELECT meas_id, seg_pos, text FROM protocol")
def protocol_text(spark, sf):
    return A.protocol_text(blocks(spark, sf)).select(*S.SEG, "text")


@query(f"WITH {BLOCKS_SQL}, {COULOMB_SQL.format(src='blocks')} SELECT meas_id, seg_pos, {sq('sum(dq) / 3600')} AS charge FROM q GROUP BY 1, 2")
def charge_throughput(spark, sf):
    return A.charge_throughput(blocks(spark, sf), 3600.0).select(*S.SEG, sig("charge").alias("charge"))


CURVES_SQL = """cq AS (SELECT *, coalesce(0.5 * (lag(abs(i)) OVER w + abs(i)) * (t - lag(t) OVER w), 0) AS dq FROM blocks WINDOW w AS (PARTITION BY meas_id, seg_pos ORDER BY pt)),
cx AS (SELECT *, sum(dq) OVER (PARTITION BY meas_id, seg_pos ORDER BY pt ROWS UNBOUNDED PRECEDING) / 3600 AS x FROM cq), ck AS (SELECT meas_id, max(x) AS k FROM cx WHERE seg_pos = 1 GROUP BY 1),
curves AS (SELECT cx.meas_id, CASE WHEN seg_pos = 0 THEN 'charge' ELSE 'discharge' END AS kind, pt, CASE WHEN seg_pos = 0 THEN x + k ELSE x - k END AS x, u, i FROM cx JOIN ck ON ck.meas_id = cx.meas_id
  WHERE seg_pos = 0 OR seg_pos = 2 AND x - k >= 0),
cap AS (SELECT c.meas_id, greatest(min(c.x), min(d.x)) AS low, least(max(c.x), max(d.x)) AS high, 0.5 * avg(c.i) - 0.5 * avg(d.i) AS i_mean FROM
  (SELECT meas_id, x, i FROM curves WHERE kind = 'charge') c JOIN (SELECT meas_id, x, i FROM curves WHERE kind = 'discharge') d ON d.meas_id = c.meas_id GROUP BY 1)"""


def cc_cv(spark, sf):
    return A.cc_cv_curves(blocks(spark, sf), 0, 1, 2)


@query(f"WITH {BLOCKS_SQL}, {CURVES_SQL} SELECT meas_id, {sq('low')} AS low, {sq('high')} AS high, {sq('i_mean')} AS i_mean FROM cap")
def cc_cv_capacity(spark, sf):
    return A.cc_cv_capacity(cc_cv(spark, sf)).select("meas_id", *sigs("low", "high", "i_mean"))


MEAN_SQL = """gk AS (SELECT meas_id, CAST(k AS INTEGER) AS k, CASE WHEN k = 8 THEN high ELSE low + (high - low) * k / 8 END AS x FROM cap, (SELECT unnest(range(0, 9)) AS k) WHERE high > low),
kn AS (SELECT meas_id, kind, x, min(u) AS y FROM curves GROUP BY 1, 2, 3), sg AS (SELECT meas_id, kind, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM kn WINDOW w AS (PARTITION BY meas_id, kind ORDER BY x)),
at_ AS (SELECT g.meas_id, g.k, g.x, s.kind, CASE WHEN s.x0 = g.x THEN s.y0 WHEN s.x1 IS NOT NULL THEN s.y0 + (g.x - s.x0) / (s.x1 - s.x0) * (s.y1 - s.y0) END AS y FROM gk g LEFT JOIN sg s ON s.meas_id = g.meas_id AND s.x0 <= g.x AND (g.x < s.x1 OR s.x1 IS NULL)),
mo AS (SELECT meas_id, k, min(x) AS x, sum(y) AS s, count(y) AS n FROM at_ GROUP BY 1, 2)"""


@query(f"WITH {BLOCKS_SQL}, {CURVES_SQL}, {MEAN_SQL} SELECT meas_id, k, {sq('x')} AS x, CASE WHEN n = 2 THEN {sq('0.5 * s')} END AS u FROM mo")
def mean_ocv(spark, sf):
    d = A.mean_ocv(cc_cv(spark, sf))
    return d.select("meas_id", "k", sig("x").alias("x"), F.when(F.col("u").isNotNull(), sig("u")).alias("u"))


@query(f"""WITH {BLOCKS_SQL}, {CURVES_SQL}, {MEAN_SQL}, src AS (SELECT meas_id, pt * 2000.0 AS x, u AS y FROM blocks WHERE seg_pos = 3), {INTERP_SQL.format(src='src')}
SELECT g.meas_id, g.k, CASE WHEN g.n = 2 AND s.x1 IS NOT NULL THEN {sq('g.s - 2 * (s.y0 + (g.x - s.x0) / (s.x1 - s.x0) * (s.y1 - s.y0))')} END AS d
FROM mo g LEFT JOIN seg s ON s.meas_id = g.meas_id AND s.x0 <= g.x AND (g.x < s.x1 OR s.x1 IS NULL)""")
def qocv_second_difference(spark, sf):
    quasi = blocks(spark, sf).filter("seg_pos = 3").select("meas_id", (F.col("pt") * 2000.0).alias("x"), F.col("u").alias("y"))
    d = A.qocv_second_difference(cc_cv(spark, sf), quasi)
    return d.select("meas_id", "k", F.when(F.col("d").isNotNull(), sig("d")).alias("d"))


@query(f"""WITH {BLOCKS_SQL}, cq AS (SELECT *, coalesce(0.5 * (lag(abs(i)) OVER w + abs(i)) * (t - lag(t) OVER w), 0) AS dq FROM blocks WINDOW w AS (PARTITION BY meas_id, seg_pos ORDER BY pt)),
cx AS (SELECT *, sum(dq) OVER (PARTITION BY meas_id, seg_pos ORDER BY pt ROWS UNBOUNDED PRECEDING) AS c FROM cq),
cs AS (SELECT *, c / nullif(max(c) OVER (PARTITION BY meas_id, seg_pos), 0) AS soc FROM cx), cb AS (SELECT meas_id, seg_pos, CAST(floor(u / 40) AS INTEGER) AS u_bin, avg(soc) AS soc, avg(u) AS u FROM cs GROUP BY 1, 2, 3),
cl AS (SELECT *, (lead(soc) OVER w - soc) / nullif(lead(u) OVER w - u, 0) AS v FROM cb WINDOW w AS (PARTITION BY meas_id, seg_pos ORDER BY u_bin))
SELECT meas_id, seg_pos, u_bin, CASE WHEN v IS NOT NULL THEN {r('v', 8)} END AS dsoc_du FROM cl""")
def incremental_capacity(spark, sf):
    return A.incremental_capacity(blocks(spark, sf), 40.0).select(*S.SEG, "u_bin", F.round("dsoc_du", 8).alias("dsoc_du"))


SERIES_SQL = "series AS (SELECT vec_id AS meas_id, k AS pt, CAST(embedding[k + 1] AS DOUBLE) AS y, len(embedding) AS n FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS k FROM embeddings))"


def series(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("meas_id"), F.size("embedding").alias("n"), F.posexplode("embedding").alias("pt", "y"))
    return e.withColumn("y", F.col("y").cast("double")).withColumn("x", F.col("pt") / 10)


@query(f"""WITH {SERIES_SQL}, m AS (SELECT meas_id, (pt / 10.0 + lag(pt / 10.0) OVER w) / 2 AS x, (y + lag(y) OVER w) / 2 AS v, pt / 10.0 - lag(pt / 10.0) OVER w AS dx FROM series WINDOW w AS (PARTITION BY meas_id ORDER BY pt))
SELECT meas_id, CAST(s.k AS INTEGER) AS k, {r('sum(v * exp(-s.a * x) * cos(s.b * x) * dx)')} AS re, {r('-sum(v * exp(-s.a * x) * sin(s.b * x) * dx)')} AS im FROM m, (VALUES (0, 0.1, 0.0), (1, 0.2, 1.5), (2, 0.0, 3.0)) s(k, a, b) WHERE x IS NOT NULL GROUP BY 1, 2""")
def laplace(spark, sf):
    d = A.laplace(series(spark, sf), S.MEAS, "x", "y", [(0.1, 0.0), (0.2, 1.5), (0.0, 3.0)])
    return d.select("meas_id", "k", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query(f"WITH {SERIES_SQL} SELECT meas_id, CAST(b.b AS INTEGER) AS bin, {r('sum(y * cos(2 * pi() * b.b * pt / n))')} AS re, {r('-sum(y * sin(2 * pi() * b.b * pt / n))')} AS im FROM series, (VALUES (1), (3), (9)) b(b) GROUP BY 1, 2")
def dft_at_frequency(spark, sf):
    d = A.dft_at_frequency(series(spark, sf), S.MEAS, F.col("pt"), F.col("n"), "y", [1, 3, 9])
    return d.select("meas_id", "bin", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


PEAK_SQL = f"""{SPECTRA_SQL}, pk AS (SELECT meas_id, pt, ln(f) AS x, re AS y FROM spectra),
pn AS (SELECT *, lag(y) OVER w AS yb, lead(y) OVER w AS ya, lag(x) OVER w AS xb, lead(x) OVER w AS xa, lag(x, 2) OVER w AS xb2, lead(x, 2) OVER w AS xa2 FROM pk WINDOW w AS (PARTITION BY meas_id ORDER BY pt)),
pm AS (SELECT *, lag(yb IS NULL AND y > 0) OVER w AS f_up, lead(ya IS NULL AND y > 0) OVER w AS l_up FROM pn WINDOW w AS (PARTITION BY meas_id ORDER BY pt)),
peaks AS (SELECT meas_id, pt, x, y, yb / 2 * (xb - coalesce(xb2, 2 * xb - x)) + (yb + y) / 2 * (x - xb) + (y + ya) / 2 * (xa - x) + ya / 2 * (coalesce(xa2, 2 * xa - x) - xa) AS area
  FROM pm WHERE yb IS NOT NULL AND ya IS NOT NULL AND ((yb < y AND ya < y) OR coalesce(f_up, false) OR coalesce(l_up, false)))"""


def _peaks(spark, sf):
    return A.peaks(spectra(spark, sf).withColumn("x", F.ln("f")), S.MEAS, "x", "re")


@query(f"WITH {PEAK_SQL} SELECT meas_id, pt, {r('area')} AS area FROM peaks")
def spectrum_peak_area(spark, sf):
    return _peaks(spark, sf).select("meas_id", F.col("pt").cast("long").alias("pt"), F.round("area", 6).alias("area"))


@query(f"WITH {PEAK_SQL} SELECT meas_id, CAST(row_number() OVER (PARTITION BY meas_id ORDER BY pt) AS INTEGER) AS rank, {r('x')} AS ln_tau, {r('area')} AS resistance FROM peaks")
def peak_features(spark, sf):
    d = A.topk_peaks(_peaks(spark, sf), S.MEAS, "pt", 1 << 30)
    return d.select("meas_id", "rank", F.round("x", 6).alias("ln_tau"), F.round("area", 6).alias("resistance"))


@query(f"""WITH {PEAK_SQL} SELECT 'first' AS kind, meas_id, rank, pt FROM (SELECT *, CAST(row_number() OVER (PARTITION BY meas_id ORDER BY pt) AS INTEGER) AS rank FROM peaks) WHERE rank <= 3
UNION ALL SELECT 'last', meas_id, rank, pt FROM (SELECT *, CAST(row_number() OVER (PARTITION BY meas_id ORDER BY pt DESC) AS INTEGER) AS rank FROM peaks) WHERE rank <= 2""")
def topk_peaks(spark, sf):
    p = _peaks(spark, sf)
    pick = lambda n, kind: A.topk_peaks(p, S.MEAS, "pt", n).select(F.lit(kind).alias("kind"), "meas_id", "rank", F.col("pt").cast("long").alias("pt"))
    return pick(3, "first").unionByName(pick(-2, "last"))


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT meas_id, seg_pos, pt, i AS soc0, u, max(i) OVER (PARTITION BY meas_id, seg_pos) AS m FROM blocks), d AS (SELECT *, CASE WHEN m <= 0 THEN -soc0 ELSE soc0 END AS soc FROM c),
o AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY meas_id, seg_pos) AS n, first_value(u) OVER w AS a, last_value(u) OVER (PARTITION BY meas_id, seg_pos ORDER BY soc, u ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM d WINDOW w AS (PARTITION BY meas_id, seg_pos ORDER BY soc, u))
SELECT meas_id, seg_pos, soc, u, CASE WHEN b > a THEN n - 1 - k ELSE k END AS ord FROM o""")
def sort_curve(spark, sf):
    d = A.sort_curve(blocks(spark, sf).withColumnRenamed("i", "soc"), S.SEG, "soc", "u")
    return d.select(*S.SEG, (F.col("soc") + 0.0).alias("soc"), "u", F.col("ord").cast("long").alias("ord"))


@query("""WITH p AS (SELECT l_orderkey AS model_id, l_linenumber AS k, l_extendedprice AS e0, CASE WHEN l_linenumber > 1 THEN l_discount END AS dx FROM lineitem),
q AS (SELECT model_id, k, min(e0) AS e0, min(dx) AS dx FROM p GROUP BY 1, 2)
SELECT model_id, k, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, coalesce(abs(lead(e0) OVER w - e0) < 1, false) AS close, round(coalesce(dx, 1 - sum(coalesce(dx, 0)) OVER (PARTITION BY model_id)), 6) + 0 AS dx FROM q WINDOW w AS (PARTITION BY model_id ORDER BY e0 DESC, k)""")
def plateau_order(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("model_id"), F.col("l_linenumber").alias("k")).agg(F.min("l_extendedprice").alias("e0"), F.min(F.when(F.col("l_linenumber") > 1, F.col("l_discount"))).alias("dx"))
    return A.plateau_order(lines, ["model_id"], 1.0).select("model_id", "k", "pos", "close", F.round("dx", 6).alias("dx"))


@query(f"""WITH {BLOCKS_SQL}, f AS (SELECT DISTINCT meas_id, 'f' || seg_pos AS feature FROM blocks)
SELECT meas_id, feature, CAST(row_number() OVER (PARTITION BY meas_id ORDER BY md5('7:' || feature), feature) - 1 AS INTEGER) AS ord FROM f""")
def feature_shuffle(spark, sf):
    features = blocks(spark, sf).select("meas_id", F.concat(F.lit("f"), F.col("seg_pos").cast("string")).alias("feature")).distinct()
    return A.feature_shuffle(features, S.MEAS, "feature", 7)


E_SQL = "(3.0 + u / 500)"
def voltage():
    return 3.0 + F.col("u") / 500


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, {r(soc_sql(E_SQL), 9)} AS soc, {r('0.1 + 0.8 * ' + soc_sql(E_SQL), 9)} AS scaled FROM raw")
def ocv_model_soc(spark, sf):
    d = raw_points(spark, sf)
    return d.select("meas_id", "pt", F.round(O.ocv_model_soc(voltage(), PLATEAUS), 9).alias("soc"), F.round(O.ocv_model_soc(voltage(), PLATEAUS, 0.1, 0.9), 9).alias("scaled"))


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, {r(d1_sql(E_SQL), 7)} AS d1 FROM raw")
def ocv_model_d1(spark, sf):
    return raw_points(spark, sf).select("meas_id", "pt", F.round(O.ocv_model_d1(voltage(), PLATEAUS), 7).alias("d1"))


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, {r(d2_sql(E_SQL), 6)} AS d2 FROM raw")
def ocv_model_d2(spark, sf):
    return raw_points(spark, sf).select("meas_id", "pt", F.round(O.ocv_model_d2(voltage(), PLATEAUS), 6).alias("d2"))


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, CASE WHEN {soc_sql(E_SQL)} BETWEEN 0.001 AND 0.999 THEN {r(E_SQL, 7)} END AS e FROM raw")
def ocv_model_inverse(spark, sf):
    """The inverse of the model gives back the voltage, where the curve isn't flat."""
    soc = O.ocv_model_soc(voltage(), PLATEAUS)
    e = O.ocv_model_inverse(F.col("soc"), PLATEAUS, 2.0, 5.0)
    return raw_points(spark, sf).withColumn("soc", soc).select("meas_id", "pt", F.when(F.col("soc").between(0.001, 0.999), F.round(e, 7)).alias("e"))


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, {sq('1 / ' + d1_sql(E_SQL))} AS d1 FROM raw WHERE {soc_sql(E_SQL)} BETWEEN 0.01 AND 0.99")
def ocv_inverse_d1(spark, sf):
    d = raw_points(spark, sf).withColumn("soc", O.ocv_model_soc(voltage(), PLATEAUS)).filter("soc between 0.01 and 0.99")
    return d.select("meas_id", "pt", sig(O.ocv_inverse_d1(F.col("soc"), PLATEAUS, 2.0, 5.0)).alias("d1"))


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, {r('-' + d2_sql(E_SQL) + ' / pow(' + d1_sql(E_SQL) + ', 3)', 3)} AS d2 FROM raw WHERE {soc_sql(E_SQL)} BETWEEN 0.05 AND 0.95")
def ocv_inverse_d2(spark, sf):
    d = raw_points(spark, sf).withColumn("soc", O.ocv_model_soc(voltage(), PLATEAUS)).filter("soc between 0.05 and 0.95")
    return d.select("meas_id", "pt", F.round(O.ocv_inverse_d2(F.col("soc"), PLATEAUS, 2.0, 5.0), 3).alias("d2"))


CURVE_SQL = "(3.0 + 0.8 * c2.s + 0.1 * tanh(10 * (c2.s - 0.5)))"
SOC_SQL = f"{COULOMB_SQL.format(src='blocks')}, c2 AS (SELECT *, 0.5 - c / 4e9 AS s FROM soc)"


def curve(s):
    return 3.0 + 0.8 * s + 0.1 * F.tanh(10 * (s - 0.5))


@query(f"""WITH {BLOCKS_SQL}, {SOC_SQL}, o AS (SELECT *, {CURVE_SQL} AS v, max(abs(i)) OVER (PARTITION BY meas_id, seg_pos) = 0 AS idle FROM c2),
p AS (SELECT *, CASE WHEN idle THEN coalesce(last_value(CASE WHEN NOT idle THEN v END IGNORE NULLS) OVER w, first_value(v) OVER w) ELSE v END AS used FROM o WINDOW w AS (PARTITION BY meas_id ORDER BY seg_pos, pt ROWS UNBOUNDED PRECEDING))
SELECT meas_id, seg_pos, pt, {r('u - used')} AS overpotential FROM p""")
def ocv_subtract(spark, sf):
    d = S.coulomb_count(blocks(spark, sf), 0.5, -1.0, 4e9)
    return A.ocv_subtract(d, curve(F.col("soc"))).select(*S.SEG, "pt", F.round("overpotential", 6).alias("overpotential"))


@query(f"WITH {BLOCKS_SQL}, {SOC_SQL} SELECT meas_id, seg_pos, pt, {r('u - ' + CURVE_SQL + ' + (0.1 + 0.6 * exp(-(0.9 - 0.8 * c2.s)))')} AS overpotential FROM c2")
def ocv_subtract_two(spark, sf):
    d = S.coulomb_count(blocks(spark, sf), 0.5, -1.0, 4e9)
    negative = 0.1 + 0.6 * F.exp(-O.soc_other(F.col("soc"), 0.9, 0.8))
    both = curve(F.col("soc")) - negative
    return d.select(*S.SEG, "pt", F.round(F.col("u") - both, 6).alias("overpotential"))


@query(f"""WITH {BLOCKS_SQL}, {ENDS_SQL.format(src='blocks')}, mm AS (SELECT meas_id, seg_pos, u1 - 80 AS m, coalesce(lag(u1 - 80) OVER (PARTITION BY meas_id ORDER BY seg_pos), u1 - 80) AS m0 FROM ends WHERE seg_pos % 2 = 1),
ramp AS (SELECT meas_id, seg_pos, m AS m0, m FROM mm UNION ALL SELECT meas_id, seg_pos - 1, m0, m FROM mm),
w AS (SELECT *, first_value(t) OVER w AS a, last_value(t) OVER w AS b FROM blocks WINDOW w AS (PARTITION BY meas_id, seg_pos ORDER BY pt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, coalesce((t - a) / nullif(b - a, 0), 0) AS tau FROM w)
SELECT x.meas_id, x.seg_pos, x.pt, {r('u - (1 - tau) * m0 - tau * m')} AS corrected FROM x JOIN ramp p ON p.meas_id = x.meas_id AND p.seg_pos = x.seg_pos""")
def ocv_mismatch_ramp(spark, sf):
    b = blocks(spark, sf)
    mismatch = S.segment_ends(b).filter("seg_pos % 2 = 1").select(*S.SEG, (F.col("u1") - 80).alias("m"))
    return A.ocv_mismatch_ramp(b, mismatch).select(*S.SEG, "pt", F.round("corrected", 6).alias("corrected"))


@query(f"""WITH {RAW_SQL}, e AS (SELECT meas_id, {soc_sql(E_SQL)} - i / 600 AS d FROM raw) SELECT meas_id, {sq('sqrt(sum(d * d))')} AS root_sum_sq, {sq('sqrt(avg(d * d))')} AS rmse, {sq('avg(abs(d))')} AS mae, {sq('max(abs(d))')} AS max_abs FROM e GROUP BY 1""")
def ocv_residuals(spark, sf):
    from voltlake.plans.views import SIGNS

    d = S.state_sign(raw_points(spark, sf), SIGNS, "state", "raw")
    return A.residual_measures(d, ["meas_id"], O.ocv_model_soc(voltage(), PLATEAUS) - F.col("raw") / 600).select("meas_id", *sigs("root_sum_sq", "rmse", "mae", "max_abs"))


LOSS_SQL = f"""{RAW_SQL}, t AS (SELECT meas_id, c.c, 3.0 + u / 500 - c.shift AS e, u / 500 AS x FROM raw, (VALUES ('a', -0.1), ('b', 0.0), ('c', 0.1)) c(c, shift)),
l AS (SELECT meas_id, c, sqrt(sum(pow({soc_sql('e')} - x, 2) / (1 + pow({d1_sql('e')}, 2)))) AS loss, max(abs({soc_sql('e')} - x)) AS largest FROM t GROUP BY 1, 2)"""


@query(f"WITH {LOSS_SQL} SELECT meas_id, arg_min(c, (loss, c)) AS candidate, {sq('min(loss)')} AS loss, arg_min(c, (largest, c)) AS candidate_largest, {sq('min(largest)')} AS largest FROM l GROUP BY 1")
def ocv_loss(spark, sf):
    """The best of a table of candidate models per measurement, by squares and by the largest difference."""
    rows = [(c, [(e0 + shift, a, dx) for e0, a, dx in O.complete(PLATEAUS)], 0.0, 1.0) for c, shift in (("a", -0.1), ("b", 0.0), ("c", 0.1))]
    models = spark.createDataFrame(rows, "candidate string, plateaus array<struct<e0:double,a:double,dx:double>>, start double, end double")
    points = raw_points(spark, sf).select("meas_id", (3.0 + F.col("u") / 500).alias("e"), (F.col("u") / 500).alias("soc"))
    best = lambda order, name, value: A.ocv_losses(points, models, ["meas_id"], order).groupBy("meas_id").agg(F.min_by("candidate", F.struct("loss", "candidate")).alias(name), F.min("loss").alias(value))
    both = best(2.0, "candidate", "loss").join(best(float("inf"), "candidate_largest", "largest"), "meas_id")
    return both.select("meas_id", "candidate", sig("loss").alias("loss"), "candidate_largest", sig("largest").alias("largest"))


PLATEAU_SQL = f"""{RAW_SQL}, v AS (SELECT meas_id, count(*) AS points, count(DISTINCT 3.0 + u / 500) AS kinds FROM raw GROUP BY 1)"""


@query(f"""WITH {PLATEAU_SQL} SELECT meas_id, points, true AS numbered, true AS falling, true AS shares, true AS slopes, true AS inside FROM v""")
def fit_ocv_plateaus(spark, sf):
    """Initial plateau models by clustering. Clusterings have no closed form; what any right one has is checked per measurement:

    clusters numbered from 0 without gaps, at most four, e0 falling and among the measurement's voltages, shares between 0 and 1, slopes positive.
    """
    from voltlake.operators.clustering import plateau_clusters

    p = raw_points(spark, sf).select("meas_id", "pt", (3.0 + F.col("u") / 500).alias("e"), (F.col("pt") / 1000).alias("soc"))
    found = plateau_clusters(p, 4)
    w = Window.partitionBy("meas_id").orderBy("k")
    d = found.withColumn("_up", F.coalesce(F.lag("e0").over(w) <= F.col("e0"), F.lit(False)))
    per = d.groupBy("meas_id").agg(((F.max("k") + 1 == F.count(F.lit(1))) & (F.max("k") < 4)).alias("numbered"), (~F.bool_or("_up")).alias("falling"), F.bool_and(F.coalesce(F.col("share").between(0, 1), F.lit(True))).alias("shares"), F.bool_and(F.col("slope") > 0).alias("slopes"), F.collect_list("e0").alias("e0s"))
    keys = ["meas_id", "numbered", "falling", "shares", "slopes"]
    own = F.array_min("e0s") >= F.min("e"), F.array_max("e0s") <= F.max("e")
    return p.join(per, "meas_id").groupBy(*keys, "e0s").agg(F.count(F.lit(1)).alias("points"), (own[0] & own[1]).alias("inside")).drop("e0s")


@query(f"WITH {BLOCKS_SQL} SELECT meas_id, seg_pos, true AS known, true AS named FROM blocks GROUP BY 1, 2")
def cycle_labels(spark, sf):
    """Clusters of segments by mean and variance of current and voltage: each segment has one of the cluster numbers, and a cluster one name."""
    from voltlake.operators.clustering import label_cycles

    found = label_cycles(A.segment_stats(blocks(spark, sf)), 4)
    names = found.groupBy("cluster").agg((F.countDistinct("name") == 1).alias("named"))
    known = F.col("cluster").between(0, 3) & F.col("name").isin("constant current", "constant voltage")
    return found.join(names, "cluster").select("meas_id", "seg_pos", known.alias("known"), "named")
