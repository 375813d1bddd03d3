"""Anomaly scores and the area under the ROC curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.pairs import nearest


def density_ratio(distances: DataFrame, k: int) -> DataFrame:
    """(id, density, score) from symmetric distances (id, other, d): density is 1 by the mean distance to the k nearest; the score is the neighbours' mean density by the own one. Null where a mean distance is 0."""
    near = nearest(distances, k)
    density = near.groupBy("id").agg(F.try_divide(F.lit(1.0), F.avg("d")).alias("density"))
    around = near.join(density.select(F.col("id").alias("other"), F.col("density").alias("theirs")), "other")
    mean = around.groupBy("id").agg(F.avg("theirs").alias("mean"))
    return density.join(mean, "id").select("id", "density", F.try_divide("mean", "density").alias("score"))


def centroid_outliers(assignment: DataFrame) -> DataFrame:
    """(id, score): distance to the own centroid."""
    return assignment.select("id", F.col("d").alias("score"))


def median_outliers(assignment: DataFrame) -> DataFrame:
    """(id, score): distance by the cluster's median distance (exact; the middle of two for even counts)."""
    med = assignment.groupBy("cluster").agg(F.expr("percentile(d, 0.5)").alias("median"))
    return assignment.join(med, "cluster").select("id", F.try_divide("d", "median").alias("score"))


def roc_auc(scores: DataFrame, label: str, positive: str, score: str = "score", tie: str = "id") -> DataFrame:
    """One row ``auc``: trapezoids under the curve of true over false positives, along ascending score.

    Counts before a row come from sums by distinct score bands first, so that only the bands'
    sums pass one task, not the rows.
    """
    x = scores.select(F.col(score).alias("s"), F.col(tie).alias("t"), (F.col(label) == positive).cast("long").alias("p"))
    w = Window.partitionBy("band").orderBy("s", "t")
    # bands by quantile of the score; within a band rows are ordered, and bands are few
    cuts = x.agg(F.percentile_approx("s", [i / 64 for i in range(1, 64)], 10000).alias("q"))
    x = x.crossJoin(F.broadcast(cuts)).withColumn("band", F.size(F.filter("q", lambda c: c < F.col("s")))).drop("q")  # one row
    sums = x.groupBy("band").agg(F.sum("p").alias("tp"), F.sum(1 - F.col("p")).alias("fp"))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("band", F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("tp0"))
    x = x.join(F.broadcast(sums), "band").withColumn("tp", F.col("tp0") + F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a negative moves the curve right by one: the area of its strip is the true positives so far
    total = x.agg(F.sum(F.when(F.col("p") == 0, F.col("tp")).otherwise(0)).alias("area"), F.sum("p").alias("n_p"), F.sum(1 - F.col("p")).alias("n_n"))
    return total.select(F.try_divide(F.col("area").cast("double"), (F.col("n_p") * F.col("n_n")).cast("double")).alias("auc"))
