"""Queries of the segment algebra, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.operators import segments as S
from voltlake.plans.views import BLOCKS_SQL, POINTS_SQL, RAW_SQL, SPECTRA_SQL, blocks, points, r, raw_points, spectra, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"WITH {POINTS_SQL} SELECT meas_id, pt, seg_pos, seg_label FROM points")
def segment_by_change(spark, sf):
    return points(spark, sf).select("meas_id", "pt", "seg_pos", "seg_label")


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, {r('i')} AS i FROM raw")
def state_sign(spark, sf):
    from voltlake.plans.views import SIGNS

    return S.state_sign(raw_points(spark, sf), SIGNS, "state", "raw").select("meas_id", "pt", F.round("raw", 6).alias("i"))


@query(f"WITH {SPECTRA_SQL} SELECT meas_id, pt, {r('-re')} AS re, {r('-im')} AS im FROM spectra")
def flip_sign(spark, sf):
    return S.flip_sign(spectra(spark, sf), "re", "im").select("meas_id", "pt", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query(f"WITH {POINTS_SQL} SELECT meas_id, seg_pos, pt, u FROM points WHERE seg_pos IN (1, 3, 5)")
def seg_filter(spark, sf):
    return S.seg_filter(points(spark, sf), [1, 3, 5]).select("meas_id", "seg_pos", "pt", "u")


@query(f"""WITH {POINTS_SQL}, n AS (SELECT *, max(seg_pos) OVER (PARTITION BY meas_id) + 1 AS n FROM points),
k AS (SELECT 0 AS r, * FROM n WHERE seg_pos >= 1 AND seg_pos < 7 AND (seg_pos - 1) % 2 = 0
  UNION ALL SELECT 1, * FROM n WHERE seg_pos >= greatest(0, n - 3)
  UNION ALL SELECT 2, * FROM n WHERE seg_pos < 2)
SELECT meas_id, seg_pos, pt, u, CAST(dense_rank() OVER (PARTITION BY meas_id ORDER BY r, seg_pos) - 1 AS INTEGER) AS new_pos FROM k""")
def seg_slice(spark, sf):
    return S.seg_slice(points(spark, sf), [(1, 7, 2), (-3, None, 1), (None, 2, 1)]).select("meas_id", "seg_pos", "pt", "u", "new_pos")


@query("SELECT l_orderkey AS meas_id, n AS new_pos, l_linenumber AS seg_pos, l_quantity AS u FROM lineitem JOIN (VALUES (0, 3), (1, 1), (2, 3)) v(n, p) ON l_linenumber = p")
def seg_gather(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("meas_id"), F.col("l_linenumber").alias("seg_pos"), F.col("l_quantity").alias("u"))
    return S.seg_gather(lines, [3, 1, 3]).select("meas_id", "new_pos", "seg_pos", "u")


@query(f"WITH {POINTS_SQL} SELECT meas_id, pt, CAST(dense_rank() OVER (PARTITION BY meas_id ORDER BY seg_pos) - 1 AS INTEGER) AS seg_pos FROM points WHERE seg_pos % 3 <> 0")
def seg_reindex(spark, sf):
    return S.seg_reindex(points(spark, sf).filter("seg_pos % 3 <> 0")).select("meas_id", "pt", "seg_pos")


@query(f"WITH {BLOCKS_SQL} SELECT meas_id, seg_pos, pt, {r('t - min(t) OVER (PARTITION BY meas_id, seg_pos)')} AS t FROM blocks")
def time_rebase(spark, sf):
    return S.time_rebase(blocks(spark, sf), S.SEG).select("meas_id", "seg_pos", "pt", F.round("t", 6).alias("t"))


CROSS_SQL = """d AS (SELECT {k}, pt, {x} AS r FROM {src}), l AS (SELECT *, lead(r) OVER w AS a, lead(pt) OVER w AS ap FROM d WINDOW w AS (PARTITION BY {k} ORDER BY pt)),
cross_ AS (SELECT {k}, coalesce(min(CASE WHEN sign(r) <> sign(a) THEN CASE WHEN abs(r) < abs(a) THEN pt ELSE ap END END),
  CASE WHEN abs(arg_min(r, pt)) < abs(arg_max(r, pt)) THEN min(pt) ELSE max(pt) END) AS pos FROM l GROUP BY {k})"""


@query(f"WITH {RAW_SQL}, {CROSS_SQL.format(k='meas_id', x='u - 80', src='raw')} SELECT meas_id, pos FROM cross_")
def nearest_crossing(spark, sf):
    return S.nearest_crossing(raw_points(spark, sf), S.MEAS, F.col("u"), F.lit(80.0))


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT *, t - first_value(t) OVER (PARTITION BY meas_id, seg_pos ORDER BY pt) AS s FROM blocks),
{CROSS_SQL.format(k='meas_id, seg_pos', x='s - 200000', src='b')}
SELECT b.meas_id, b.seg_pos, b.pt, b.u FROM b JOIN cross_ c ON b.meas_id = c.meas_id AND b.seg_pos = c.seg_pos WHERE b.pt >= c.pos""")
def trim_head(spark, sf):
    return S.trim_head(blocks(spark, sf), 200000.0).select("meas_id", "seg_pos", "pt", "u")


@query(f"""WITH {BLOCKS_SQL}, e AS (SELECT *, min(t) OVER (PARTITION BY meas_id, seg_pos) AS a, max(t) OVER (PARTITION BY meas_id, seg_pos) AS b FROM blocks)
SELECT 'window' AS kind, meas_id, seg_pos, pt, u FROM e WHERE t >= a + 50000 AND t <= a + 400000
UNION ALL SELECT 'last', meas_id, seg_pos, pt, u FROM e WHERE t >= b - 300000""")
def keep_window(spark, sf):
    b = blocks(spark, sf)
    pick = lambda d, kind: d.select(F.lit(kind).alias("kind"), "meas_id", "seg_pos", "pt", "u")
    return pick(S.keep_window(b, 50000.0, 400000.0), "window").unionByName(pick(S.keep_window(b, None, None, 300000.0), "last"))


@query(f"""WITH {BLOCKS_SQL}, s AS (SELECT *, sign(u - lag(u) OVER (PARTITION BY meas_id, seg_pos ORDER BY pt)) AS s FROM blocks),
v AS (SELECT *, sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) OVER w AS up, sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) OVER w AS down,
  max(u) OVER q AS hi, min(u) OVER q AS lo FROM s WINDOW w AS (PARTITION BY meas_id, seg_pos), q AS (PARTITION BY meas_id, seg_pos ORDER BY pt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT * FROM v WHERE CASE WHEN up >= down THEN down = 0 OR hi IS NULL OR u > hi ELSE up = 0 OR lo IS NULL OR u < lo END)
SELECT meas_id, seg_pos, pt, u, CAST(row_number() OVER (PARTITION BY meas_id, seg_pos ORDER BY CASE WHEN up >= down THEN pt ELSE -pt END) - 1 AS INTEGER) AS ord FROM k""")
def monotone_cleanup(spark, sf):
    return S.monotone_cleanup(blocks(spark, sf), S.SEG, "u").select("meas_id", "seg_pos", "pt", "u", "ord")


@query(f"""WITH {RAW_SQL} SELECT meas_id, b AS bucket, count(*) AS n, {r('avg(u)')} AS u FROM
(SELECT *, CASE WHEN pt < 10 THEN 'early' WHEN pt < 30 THEN 'middle' WHEN pt >= 40 AND pt < 60 THEN 'late' END AS b FROM raw) WHERE b IS NOT NULL GROUP BY 1, 2""")
def interval_bucket(spark, sf):
    d = S.interval_bucket(raw_points(spark, sf), [("early", 0, 10), ("middle", 10, 30), ("late", 40, 60)])
    return d.groupBy("meas_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("u"), 6).alias("u"))


@query(f"WITH {SPECTRA_SQL} SELECT meas_id, pt, {r('re')} AS re FROM spectra WHERE pt >= 13 AND pt <= 50 AND (pt - 13) % 3 = 0")
def freq_window(spark, sf):
    """0.011 Hz lies nearest to point 13, 97 Hz to point 63 * (3 + log10 97) / 5 rounded on the linear frequency axis."""
    return S.freq_window(spectra(spark, sf), 0.011, 9.0, 3).select("meas_id", "pt", F.round("re", 6).alias("re"))


@query(f"WITH {SPECTRA_SQL} SELECT meas_id, count(*) AS n FROM spectra WHERE im + 0.05 < 0 GROUP BY 1")
def capacitive_only(spark, sf):
    shifted = spectra(spark, sf).withColumn("im", F.col("im") + 0.05)
    return S.capacitive_only(shifted).groupBy("meas_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RAW_SQL} SELECT meas_id, pt, CASE WHEN i > 0 THEN i END AS i FROM raw")
def null_nonpositive(spark, sf):
    from voltlake.plans.views import SIGNS

    signed = S.state_sign(raw_points(spark, sf), SIGNS, "state", "raw").withColumnRenamed("raw", "i")
    return S.null_nonpositive(signed, "i").select("meas_id", "pt", "i")


@query("""SELECT 'event_id' AS name, count(event_id) > 0 AS present FROM events UNION ALL SELECT 'value', count(value) > 0 FROM events
UNION ALL SELECT 'missing', count(nullif(event_type, event_type)) > 0 FROM events""")
def column_presence(spark, sf):
    return S.column_presence(table(spark, sf, "events").select("event_id", "value", F.nullif(F.col("event_type"), F.col("event_type")).alias("missing")))


@query("SELECT vec_id AS meas_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS pt, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0 AS u FROM embeddings")
def explode_points(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("meas_id"), F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("u"))
    return S.explode_points(e, ["meas_id"], ["u"])


@query(f"WITH {BLOCKS_SQL} SELECT meas_id, seg_pos, array_to_string(list(CAST(round(u * 100) AS BIGINT) ORDER BY pt), ',') AS u, len(list(t)) AS n FROM blocks GROUP BY 1, 2")
def nest_points(spark, sf):
    n = S.nest_points(blocks(spark, sf), S.SEG, ["t", "u"])
    return n.select("meas_id", "seg_pos", F.array_join(F.transform("u", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("u"), F.size("t").cast("long").alias("n"))


MERGE_SQL = f"""{POINTS_SQL}, f AS (SELECT meas_id, seg_pos, CASE WHEN arg_min(u, pt) > 150 THEN 2 WHEN arg_min(state, pt) IN ('click', 'view') THEN 1 ELSE -1 END AS g FROM points GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN lag(g) OVER (PARTITION BY meas_id ORDER BY seg_pos) = g THEN 0 ELSE 1 END AS n FROM f),
merged AS (SELECT meas_id, seg_pos, g, CAST(sum(n) OVER (PARTITION BY meas_id ORDER BY seg_pos ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS merged_pos FROM m)"""
def rules():
    return F.when(F.col("u") > 150, 2).when(F.col("state").isin("click", "view"), 1)



@query(f'WITH {MERGE_SQL} SELECT p.meas_id, p.pt, p.seg_pos, m.g AS "group", m.merged_pos FROM points p JOIN merged m ON p.meas_id = m.meas_id AND p.seg_pos = m.seg_pos')
def segment_merge(spark, sf):
    return S.segment_merge(points(spark, sf), rules()).select("meas_id", "pt", "seg_pos", "group", "merged_pos")


@query(f"""WITH {MERGE_SQL}, g AS (SELECT meas_id, merged_pos, min(seg_pos) AS first_label, count(*) AS members FROM merged GROUP BY 1, 2)
SELECT meas_id, merged_pos, CAST(first_label - coalesce(sum(members - 1) OVER (PARTITION BY meas_id ORDER BY merged_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS label FROM g""")
def segment_renumber(spark, sf):
    merged = S.segment_merge(points(spark, sf), rules()).groupBy("meas_id", "merged_pos").agg(F.min("seg_pos").alias("first_label"), F.countDistinct("seg_pos").alias("members"))
    return S.segment_renumber(merged).select("meas_id", "merged_pos", F.col("label").cast("long").alias("label"))


COULOMB_SQL = """q AS (SELECT *, coalesce(0.5 * (lag(i) OVER w + i) * (t - lag(t) OVER w), 0) AS dq FROM {src} WINDOW w AS (PARTITION BY meas_id, seg_pos ORDER BY pt)),
soc AS (SELECT *, sum(dq) OVER (PARTITION BY meas_id ORDER BY seg_pos, pt ROWS UNBOUNDED PRECEDING) AS c FROM q)"""


@query(f"WITH {BLOCKS_SQL}, {COULOMB_SQL.format(src='blocks')} SELECT meas_id, seg_pos, pt, {r('0.5 - c / 3.6e9', 6)} AS soc FROM soc")
def coulomb_count(spark, sf):
    return S.coulomb_count(blocks(spark, sf), 0.5, -1.0, 3.6e9).select("meas_id", "seg_pos", "pt", F.round("soc", 6).alias("soc"))


@query(f"""WITH {BLOCKS_SQL}, w AS (SELECT *, first_value(t) OVER w AS a, last_value(t) OVER w AS b FROM blocks WINDOW w AS (PARTITION BY meas_id, seg_pos ORDER BY pt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT meas_id, seg_pos, pt, {r('(t - a) / nullif(b - a, 0)')} AS x FROM w""")
def unit_interval(spark, sf):
    w = S.whole(*S.SEG)
    span = F.last("t").over(w) - F.first("t").over(w)
    x = F.when(span != 0, S.unit_interval(F.col("t"), S.SEG))
    return blocks(spark, sf).select("meas_id", "seg_pos", "pt", F.round(x, 6).alias("x"))


ENDS_SQL = """ends AS (SELECT meas_id, seg_pos, arg_min(t, pt) AS t0, arg_max(t, pt) AS t1, arg_min(u, pt) AS u0, arg_max(u, pt) AS u1,
  avg(i) AS i_mean, avg(abs(i)) AS i_abs, count(*) AS n FROM {src} GROUP BY 1, 2)"""


@query(f"""WITH {POINTS_SQL}, {ENDS_SQL.format(src='points')} SELECT meas_id, seg_pos, {r('coalesce(u0 - lag(u1) OVER (PARTITION BY meas_id ORDER BY seg_pos), 0)')} AS ir_step FROM ends""")
def ir_step(spark, sf):
    return S.ir_step(S.segment_ends(points(spark, sf))).select("meas_id", "seg_pos", F.round("ir_step", 6).alias("ir_step"))


@query(f"""WITH {BLOCKS_SQL}, {ENDS_SQL.format(src='blocks')} SELECT meas_id, seg_pos, {r('lead(u1) OVER (PARTITION BY meas_id ORDER BY seg_pos) - u1')} AS delta FROM ends""")
def delta_static(spark, sf):
    return S.delta_static(S.segment_ends(blocks(spark, sf)), "u1").select("meas_id", "seg_pos", F.round("delta", 6).alias("delta"))


@query(f"""WITH {BLOCKS_SQL}, n AS (SELECT *, lag(u) OVER w AS b, lead(u) OVER w AS a FROM blocks WINDOW w AS (PARTITION BY meas_id, seg_pos ORDER BY pt)),
e AS (SELECT *, abs(u - 0.5 * (b + a)) * sqrt(pi() / 2) AS x FROM n)
SELECT meas_id, seg_pos, pt, {r('coalesce(x, CASE WHEN b IS NULL THEN lead(x) OVER w ELSE lag(x) OVER w END)')} AS noise FROM e WINDOW w AS (PARTITION BY meas_id, seg_pos ORDER BY pt)""")
def noise_estimate(spark, sf):
    return S.noise_estimate(blocks(spark, sf), S.SEG, "u").select("meas_id", "seg_pos", "pt", F.round("noise", 6).alias("noise"))
