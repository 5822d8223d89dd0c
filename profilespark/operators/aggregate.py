"""Aggregation, quality metrics, normalisation and enrichment of the matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilespark.bundle import SpatialDataset, measured, present
from profilespark.functions.stats import t_two_sided

AGGREGATES = {"median": F.median, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def _constant(c: str) -> Column:
    """The value of a column where a group has just one, null counted as a value."""
    one = (F.count_distinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))) <= 1
    return F.when(one, F.first(c, ignorenulls=True)).alias(c)


def aggregate_proteins(ds: SpatialDataset, grouping_columns: list[str], agg_func: str = "median") -> SpatialDataset:
    """One row per group of proteins; obs columns stay where constant; proteins with a null key are dropped.

    The new obs_id joins the keys by "_". Missing values don't enter the aggregate.
    """
    f = AGGREGATES[agg_func]
    key = F.concat_ws("_", *[F.col(c).cast("string") for c in grouping_columns])
    obs = ds.obs.dropna(subset=grouping_columns).withColumn("_g", key)
    rest = [c for c in ds.obs.columns if c not in ("obs_id", "obs_pos", *grouping_columns)]
    grouped = obs.groupBy("_g", *grouping_columns).agg(F.min("obs_pos").alias("obs_pos"), F.count("*").alias("n_merged_proteins"), *[_constant(c) for c in rest])
    cells = ds.cells.join(obs.select("obs_id", "_g"), "obs_id").groupBy(F.col("_g").alias("obs_id"), "var_id")
    cells = cells.agg(*[f(measured(c)).alias(c) for c in ["x", *ds.layer_names()]])
    return ds.with_(cells=cells, obs=grouped.withColumnRenamed("_g", "obs_id"), scores=None, edges=None)


def aggregate_samples(ds: SpatialDataset, grouping_columns: list[str], agg_func: str = "median") -> SpatialDataset:
    """One column per group of samples, named by its keys joined with "_"; null keys are dropped."""
    f = AGGREGATES[agg_func]
    key = F.concat_ws("_", *[F.col(c).cast("string") for c in grouping_columns])
    var = ds.var.dropna(subset=grouping_columns).withColumn("_g", key)
    rest = [c for c in ds.var.columns if c not in ("var_id", "var_pos", *grouping_columns)]
    grouped = var.groupBy("_g", *grouping_columns).agg(F.min("var_pos").alias("var_pos"), F.count("*").alias("n_merged_samples"), *[_constant(c) for c in rest])
    cells = ds.cells.join(var.select("var_id", "_g"), "var_id").groupBy("obs_id", F.col("_g").alias("var_id"))
    cells = cells.agg(*[f(measured(c)).alias(c) for c in ["x", *ds.layer_names()]])
    return ds.with_(cells=cells, var=grouped.withColumnRenamed("_g", "var_id"))


def qc_obs(ds: SpatialDataset) -> DataFrame:
    """Per protein: samples it is detected in, mean over all samples, total, logs, and the share of samples without it."""
    n_var = ds.var.select("var_id").distinct().count()
    each = ds.cells.groupBy("obs_id").agg(F.count_if(present()).alias("n_samples_by_intensity"), F.sum(measured()).alias("total_intensity"))
    each = ds.obs.select("obs_id").join(each, "obs_id", "left").fillna(0, ["n_samples_by_intensity", "total_intensity"])
    mean = F.col("total_intensity") / n_var
    return each.select(
        "obs_id", "n_samples_by_intensity", "total_intensity", mean.alias("mean_intensity"), F.log1p(mean).alias("log1p_mean_intensity"),
        F.log1p("total_intensity").alias("log1p_total_intensity"), (100 - 100 * F.col("n_samples_by_intensity") / n_var).alias("pct_dropout_by_intensity"),
    )


def qc_var(ds: SpatialDataset, percent_top: tuple[int, ...] = (50, 100, 200, 500)) -> DataFrame:
    """Per sample: proteins detected, total, and the share of the total that its largest N values hold."""
    n_obs = ds.obs.select("obs_id").distinct().count()
    rank = F.row_number().over(Window.partitionBy("var_id").orderBy(F.desc("x"), "obs_id"))
    ranked = ds.cells.where(present()).withColumn("r", rank)
    tops = [F.sum(F.when(F.col("r") <= n, F.col("x"))).alias(f"top{n}") for n in percent_top]
    each = ranked.groupBy("var_id").agg(F.count("*").alias("n"), F.sum("x").alias("total"), *tops)
    each = ds.var.select("var_id").distinct().join(each, "var_id", "left").fillna(0)
    shares = [F.when(F.col("total") != 0, 100 * F.col(f"top{n}") / F.col("total")).alias(f"pct_intensity_in_top_{n}_proteins") for n in percent_top]
    return each.select("var_id", F.col("n").alias("n_proteins_by_intensity"), F.col("total").alias("total_intensity"), (100 - 100 * F.col("n") / n_obs).alias("pct_dropout_by_intensity"), *shares)


def replicate_cv(ds: SpatialDataset, grouping_columns: list[str], is_log: bool = False) -> DataFrame:
    """obs_id, the groups, cv: spread of replicates over their mean; null where a replicate is missing.

    For logs of values: sqrt(exp(variance) - 1). A group's replicates without a cell count as missing.
    """
    var = ds.var.dropna(subset=grouping_columns).select("var_id", *grouping_columns)
    size = var.groupBy(*grouping_columns).agg(F.count("*").alias("size"))
    by = ds.cells.join(var, "var_id").groupBy("obs_id", *grouping_columns)
    stats = by.agg(F.count_if(present()).alias("n"), F.avg(measured()).alias("m"), F.var_pop(measured()).alias("v")).join(size, grouping_columns)
    cv = F.sqrt(F.exp("v") - 1) if is_log else F.sqrt("v") / F.col("m")
    return stats.select("obs_id", *grouping_columns, F.when(F.col("n") == F.col("size"), cv).alias("cv"))


def normalize_total(ds: SpatialDataset, target_sum: float | None = None) -> SpatialDataset:
    """Each sample scaled to the target, by default the median of the samples' totals; totals of 0 are left as they are.

    The totals are one row per sample, joined back to the cells; no window over the matrix is needed.
    """
    totals = ds.cells.groupBy("var_id").agg(F.sum(measured()).alias("total")).where("total > 0")
    if target_sum is None:
        target = totals.agg(F.median("total").alias("target"))
        totals = totals.join(F.broadcast(target))
    else:
        totals = totals.withColumn("target", F.lit(float(target_sum)))
    scaled = ds.cells.join(totals, "var_id", "left").withColumn("x", F.when(F.col("total").isNotNull(), F.col("x") * F.col("target") / F.col("total")).otherwise(F.col("x")))
    return ds.with_(cells=scaled.drop("total", "target"))


def log1p(ds: SpatialDataset) -> SpatialDataset:
    return ds.with_(cells=ds.cells.withColumn("x", F.log1p("x")))


def scale(ds: SpatialDataset) -> SpatialDataset:
    """Z-scores of each sample over its measured values."""
    s = ds.cells.groupBy("var_id").agg(F.avg(measured()).alias("m"), F.stddev_samp(measured()).alias("s"))
    return ds.with_(cells=ds.cells.join(s, "var_id").withColumn("x", (measured() - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).drop("m", "s"))


def minmax_rows(ds: SpatialDataset) -> SpatialDataset:
    """Each protein's values from 0 to 1; where all are equal, 0."""
    s = ds.cells.groupBy("obs_id").agg(F.min(measured()).alias("lo"), F.max(measured()).alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return ds.with_(cells=ds.cells.join(s, "obs_id").withColumn("x", (measured() - F.col("lo")) / span).drop("lo", "hi"))


def area_normalize(ds: SpatialDataset, replicate_column: str) -> SpatialDataset:
    """Each protein's values of a replicate as shares of their sum."""
    var = ds.var.select("var_id", F.col(replicate_column).alias("_r"))
    cells = ds.cells.join(var, "var_id")
    total = F.sum(measured()).over(Window.partitionBy("obs_id", "_r"))
    return ds.with_(cells=cells.withColumn("x", measured() / F.when(total != 0, total)).drop("_r"))


def highly_variable_proteins(ds: SpatialDataset, n_top: int = 2000, bins: int = 20) -> DataFrame:
    """obs_id, mean, dispersion, dispersion_norm, highly_variable: variance over mean, scored within bins of the mean."""
    n_var = ds.var.select("var_id").distinct().count()
    s = ds.cells.groupBy("obs_id").agg(F.sum(measured()).alias("s"), F.sum(measured() * measured()).alias("q"))
    mean = F.col("s") / n_var
    s = s.where("s > 0").select("obs_id", mean.alias("mean"), ((F.col("q") - n_var * mean * mean) / (n_var - 1)).alias("var"))
    s = s.withColumn("dispersion", F.log(F.when(F.col("var") > 0, F.col("var") / F.col("mean")))).withColumn("mean", F.log1p("mean"))
    ends = s.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    s = s.join(F.broadcast(ends)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("mean") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins)))
    by = s.groupBy("bin").agg(F.avg("dispersion").alias("m"), F.stddev_samp("dispersion").alias("sd"))
    norm = F.when(F.col("sd") > 0, (F.col("dispersion") - F.col("m")) / F.col("sd")).when(F.col("dispersion").isNotNull(), 1.0)
    s = s.join(F.broadcast(by), "bin").withColumn("dispersion_norm", norm)
    top = s.orderBy(F.desc_nulls_last("dispersion_norm"), "obs_id").limit(n_top).select("obs_id", F.lit(True).alias("highly_variable"))
    return s.join(top, "obs_id", "left").select("obs_id", "mean", "dispersion", "dispersion_norm", F.coalesce("highly_variable", F.lit(False)).alias("highly_variable"))


def covariate_columns(ds: SpatialDataset, covariates: list[str] | str | None) -> list[str]:
    found = [c for c in ds.var.columns if c.startswith("covariate_")] if covariates is None else [covariates] if isinstance(covariates, str) else list(covariates)
    missing = [c for c in found if c not in ds.var.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return found


def enrichment_vs_untagged(
    ds: SpatialDataset, covariates: list[str] | str | None = None, enrichment_column: str = "subcellular_enrichment", untagged_name: str = "UNTAGGED", p_values: bool = True
) -> DataFrame:
    """obs_id, condition, enrichment, lfc, t, df (, pval): each target against the untagged samples of its condition.

    lfc is the difference of medians; t is Student's with pooled variance. A condition joins its non-null covariates.
    Two aggregations over the cells: one row per protein, condition and target, and the same for the controls.
    """
    cov = covariate_columns(ds, covariates)
    condition = F.concat_ws("_", *[F.col(c).cast("string") for c in cov]) if cov else F.lit("")
    var = ds.var.where(F.col(enrichment_column).isNotNull()).select("var_id", condition.alias("condition"), F.col(enrichment_column).alias("enrichment"))
    bare = var.where(F.col("enrichment") != untagged_name).select("condition").distinct().join(var.where(F.col("enrichment") == untagged_name).select("condition").distinct(), "condition", "left_anti")
    if bare.limit(1).count():
        raise ValueError("a condition has no untagged samples")
    rows = ds.cells.where(present()).join(var, "var_id")
    stats = lambda df, *keys: df.groupBy("obs_id", *keys).agg(F.count("*").alias("n"), F.median("x").alias("med"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    a = stats(rows.where(F.col("enrichment") != untagged_name), "condition", "enrichment")
    b = stats(rows.where(F.col("enrichment") == untagged_name), "condition").withColumnsRenamed({"n": "n0", "med": "med0", "m": "m0", "v": "v0"})
    j = a.join(b, ["obs_id", "condition"])
    df = F.col("n") + F.col("n0") - 2
    pooled = (F.coalesce("v", F.lit(0.0)) * (F.col("n") - 1) + F.coalesce("v0", F.lit(0.0)) * (F.col("n0") - 1)) / F.when(df > 0, df)
    t = F.when(pooled > 0, (F.col("m") - F.col("m0")) / F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("n0"))))
    out = j.select("obs_id", "condition", "enrichment", (F.col("med") - F.col("med0")).alias("lfc"), t.alias("t"), df.alias("df"))
    return out.withColumn("pval", t_two_sided("t", "df")) if p_values else out


def enrichment_vs_all(
    ds: SpatialDataset, covariates: list[str] | str | None = None, enrichment_column: str = "subcellular_enrichment", method: str = "lfc", correlation_threshold: float = 1.0, group: str | None = None
) -> DataFrame:
    """obs_id, condition, enrichment, x: each target's median against the medians of the condition's other targets.

    Controls are targets whose profile correlates with the target's below the threshold. lfc: the difference to the
    controls' median; proportion: the share of the sum of target and controls.
    """
    if method not in ("lfc", "proportion"):
        raise ValueError(method)
    cov = covariate_columns(ds, covariates)
    condition = F.concat_ws("_", *[F.col(c).cast("string") for c in cov]) if cov else F.lit("")
    if group:
        condition = F.col(group)
    var = ds.var.where(F.col(enrichment_column).isNotNull() & condition.isNotNull()).select("var_id", condition.alias("condition"), F.col(enrichment_column).alias("enrichment"))
    med = ds.cells.where(present()).join(var, "var_id").groupBy("condition", "obs_id", "enrichment").agg(F.median("x").alias("x"))
    other = med.withColumnsRenamed({"enrichment": "control", "x": "y"})
    pairs = med.join(other, ["condition", "obs_id"]).where("enrichment <> control")
    if correlation_threshold < 1.0:
        low = pairs.groupBy("condition", "enrichment", "control").agg(F.corr("x", "y").alias("r")).where(F.col("r") < correlation_threshold)
        pairs = pairs.join(low.drop("r"), ["condition", "enrichment", "control"])
    value = F.first("x") - F.median("y") if method == "lfc" else F.first("x") / F.when(F.first("x") + F.sum("y") != 0, F.first("x") + F.sum("y"))
    return pairs.groupBy("obs_id", "condition", "enrichment").agg(value.alias("x"))
