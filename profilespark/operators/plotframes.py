"""The tables that figures are drawn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilespark.bundle import SpatialDataset, measured, present


def marker_profiles(ds: SpatialDataset, labels: DataFrame) -> DataFrame:
    """label, var_id, mean, std, sem, n over the label's measured proteins; std with n in the denominator."""
    rows = ds.cells.where(present()).join(labels.where("label IS NOT NULL"), "obs_id")
    by = rows.groupBy("label", "var_id").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("*").alias("n"))
    return by.withColumn("sem", F.col("std") / F.sqrt("n"))


def volcano(enrichment: DataFrame, lfc_cutoff: float = 1.0, p_cutoff: float = 0.05, n_labels: int = 10) -> DataFrame:
    """The contrasts with -log10 p, whether they are hits, and whether they are among the n best hits of their target."""
    if "pval" not in enrichment.columns:
        raise ValueError("no p-values")
    e = enrichment.withColumn("neg_log10_p", -F.log10(F.greatest("pval", F.lit(1e-300))))
    e = e.withColumn("hit", F.coalesce((F.abs("lfc") > lfc_cutoff) & (F.col("pval") < p_cutoff), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("condition", "enrichment").orderBy(F.desc("hit"), F.desc("neg_log10_p"), "obs_id"))
    return e.withColumn("labelled", F.col("hit") & (rank <= n_labels))


def resolve_bound(df: DataFrame, column: str, bound: float | str) -> float:
    """A number, or "p99" for the 99th percentile of the values there are."""
    if isinstance(bound, str):
        if not bound.startswith("p"):
            raise ValueError(bound)
        return df.agg(F.percentile(column, float(bound[1:]) / 100)).first()[0]
    return float(bound)


def embedding_probability(coordinates: DataFrame, probability: DataFrame, lo: float | str = "p1", hi: float | str = "p99", a_min: float = 0.1, a_max: float = 1.0) -> DataFrame:
    """The coordinates with alpha = a_min + (a_max - a_min) clip((p - lo) / (hi - lo)), and the order to draw them in,
    nulls first. A null probability counts as lo."""
    j = coordinates.join(probability, "obs_id", "left")
    a, b = resolve_bound(j, "p", lo), resolve_bound(j, "p", hi)
    a, b = (0.0 if a is None else a), (1.0 if b is None else b)
    span = b - a if b > a else 1.0
    share = F.least(F.greatest((F.coalesce("p", F.lit(a)) - a) / span, F.lit(0.0)), F.lit(1.0))
    return j.withColumn("alpha", a_min + (a_max - a_min) * share).withColumn("z_order", F.row_number().over(Window.orderBy(F.asc_nulls_first("p"), "obs_id")).cast("long"))


def pair_distances(vectors: DataFrame, proteins: list[str]) -> DataFrame:
    """a, b, distance between the proteins asked for, for a cluster map; a list of names, not the whole table."""
    v = vectors.where(F.col("obs_id").isin(*proteins))
    a, b = v.select(F.lit(0).alias("k"), F.col("obs_id").alias("a"), F.col("vec").alias("x")), v.select(F.lit(0).alias("k"), F.col("obs_id").alias("b"), F.col("vec").alias("y"))
    d = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: ((p - q) * (p - q)).cast("double")), F.lit(0.0), lambda s, t: s + t))
    return a.join(b, "k").select("a", "b", d.alias("distance"))


def ellipse(mean: np.ndarray, cov: np.ndarray, loadings: np.ndarray, n_std: float = 2.0) -> dict[str, float]:
    """A component's ellipse in the plane of two loadings: centre, width, height and angle in degrees."""
    m, c = loadings.T @ mean, loadings.T @ cov @ loadings
    w, v = np.linalg.eigh(c)
    return {"x": float(m[0]), "y": float(m[1]), "width": float(2 * n_std * np.sqrt(w[1])), "height": float(2 * n_std * np.sqrt(max(w[0], 0.0))), "angle": float(np.degrees(np.arctan2(v[1, 1], v[0, 1])))}


def component_samples(mean: np.ndarray, cov: np.ndarray, n: int = 100, seed: int = 0) -> np.ndarray:
    """Draws of a component, for its contours."""
    return np.random.default_rng(seed).multivariate_normal(mean, cov, n)


def true_class_probability(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """obs_id, label, value: the score of each labelled protein's own label, 0 where it has none."""
    s = scores.select("obs_id", F.col("category").alias("label"), "value")
    return labels.where("label IS NOT NULL").join(s, ["obs_id", "label"], "left").select("obs_id", "label", F.coalesce("value", F.lit(0.0)).alias("value"))


def ternary(ds: SpatialDataset) -> DataFrame:
    """obs_id, a, b, c: the shares of just three samples."""
    names = [r[0] for r in ds.var.orderBy("var_pos", "var_id").select("var_id").limit(4).collect()]
    if len(names) != 3:
        raise ValueError("exactly three samples are needed")
    value = lambda v: F.coalesce(F.sum(F.when(F.col("var_id") == v, measured())), F.lit(0.0))
    w = ds.cells.groupBy("obs_id").agg(*[value(v).alias(c) for v, c in zip(names, "abc")])
    total: Column = F.col("a") + F.col("b") + F.col("c")
    return w.where(total > 0).select("obs_id", *[(F.col(c) / total).alias(c) for c in "abc"])


def mr_hits(scores: DataFrame, m: float = 2.0, r: float = 0.68) -> DataFrame:
    return scores.withColumn("hit", F.coalesce((F.col("m") >= m) & (F.col("r") >= r), F.lit(False)))


def score_histogram(scores: DataFrame, column: str = "score", bins: int = 50) -> DataFrame:
    """bin, lo, n: counts in equal bins from the least to the largest value."""
    ends = scores.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    j = scores.where(F.col(column).isNotNull()).join(F.broadcast(ends)).withColumn("w", width).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / F.col("w"))).cast("int"))
    return j.groupBy("bin").agg(F.min(F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), F.count("*").alias("n"))
