"""Clusterings: of voltages by histograms, of segments by MLlib."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltlake.operators.storage import staged


BINS, ROUNDS, PART_ROWS = 1024, 60, 200_000


def plateau_clusters(df: DataFrame, plateaus: int, keys: Sequence[str] = ("meas_id",)) -> DataFrame:
    """keys, k, e0, share, slope: clusters of each measurement's log voltage (columns pt, e > 0, soc), by falling voltage.

    e0 is a cluster's median voltage, share the part of the measurement's SOC between the cluster's first and last point, slope the median change
    of SOC with voltage over neighbouring points, 1 where it isn't positive. The cluster borders are found on a histogram of BINS
    bins per measurement, so they depend neither on partitioning nor on a measurement's length. Fewer clusters where there are fewer voltages.
    """
    keys = list(keys)
    d = df.withColumn("_v", F.ln("e")).filter(F.col("_v").isNotNull())
    range_ = d.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min_by("soc", "pt").alias("_s0"), F.max_by("soc", "pt").alias("_s1"))
    d = d.join(range_, keys)
    cell = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * BINS), F.lit(BINS - 1))
    d = d.withColumn("_bin", F.coalesce(cell, F.lit(0)).cast("int"))
    counts = d.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("v"))

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_bin")
        v, n = pdf["v"].to_numpy(), pdf["n"].to_numpy().astype(float)
        k = min(plateaus, len(v))
        part = (np.cumsum(n) - n / 2) / n.sum()
        centres = np.unique(v[np.minimum(np.searchsorted(part, (np.arange(k) + 0.5) / k), len(v) - 1)])
        for _ in range(ROUNDS):
            of = np.abs(v[:, None] - centres).argmin(1)
            weight = np.bincount(of, n, len(centres))
            new = np.bincount(of, n * v, len(centres))[weight > 0] / weight[weight > 0]
            if len(new) == len(centres) and np.allclose(new, centres, rtol=0, atol=1e-12):
                break
            centres = new
        of = len(centres) - 1 - np.abs(v[:, None] - centres).argmin(1)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(v) for c in keys}, "_bin": pdf["_bin"].to_numpy(), "k": of.astype("int32")})

    kinds = dict(d.dtypes)
    placed = counts.groupBy(*keys).applyInPandas(borders, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", _bin int, k int")
    w = Window.partitionBy(*keys).orderBy("pt")
    step = (F.lead("soc").over(w) - F.lag("soc").over(w)) / F.nullif(F.lead("e").over(w) - F.lag("e").over(w), F.lit(0.0))
    per = d.withColumn("_slope", step).join(placed, [*keys, "_bin"]).groupBy(*keys, "k").agg(
        F.median("e").alias("e0"), F.min_by("soc", "pt").alias("_a"), F.max_by("soc", "pt").alias("_b"), F.first("_s0").alias("_s0"), F.first("_s1").alias("_s1"), F.median("_slope").alias("_m"),
    )
    share = F.abs((F.col("_b") - F.col("_a")) / F.nullif(F.col("_s1") - F.col("_s0"), F.lit(0.0)))
    return per.select(*keys, "k", "e0", share.alias("share"), F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0).alias("slope"))


def label_cycles(stats: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Adds cluster and name to segments (i_mean, i_var, u_mean, u_var): k from 2 to ``most`` by silhouette; named by what varies less within the cluster.

    The rows are put in one order, in a number of partitions that follows from theirs, first, as MLlib's start depends on both.
    """
    features = ["i_mean", "i_var", "u_mean", "u_var"]
    known = staged(stats.dropna(subset=features), "stats")
    parts = max(4, -(-known.count() // PART_ROWS))
    raw = VectorAssembler(inputCols=features, outputCol="raw").transform(known.repartition(parts, "meas_id").sortWithinPartitions("meas_id", "seg_pos"))
    data = StandardScaler(inputCol="raw", outputCol="features").fit(raw).transform(raw).persist()
    best = None
    for k in range(2, most + 1):
        found = KMeans(k=k, seed=seed).fit(data).transform(data)
        score = ClusteringEvaluator().evaluate(found)
        if best is None or score > best[0]:
            best = (score, found)
    found = staged(best[1].select("meas_id", "seg_pos", "i_var", "u_var", "prediction"), "clusters")
    data.unpersist()
    names = found.groupBy("prediction").agg(F.when(F.avg("i_var") < F.avg("u_var"), "constant current").otherwise("constant voltage").alias("name"))
    return found.join(names, "prediction").select("meas_id", "seg_pos", F.col("prediction").alias("cluster"), "name")
