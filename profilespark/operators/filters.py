"""Row and column filters of the matrix. Detection means a value that is neither null, NaN nor 0."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilespark.bundle import SpatialDataset, measured, present
from profilespark.session import broadcast_if_small


def _threshold(ds: SpatialDataset, axis: str, limits: dict[str, float | None]) -> DataFrame:
    given = {k: v for k, v in limits.items() if v is not None}
    if len(given) != 1:
        raise ValueError("exactly one threshold must be given")
    (name, value), ids = next(iter(given.items())), ds.obs if axis == "obs_id" else ds.var
    sums = ds.cells.groupBy(axis).agg(F.sum(measured()).alias("counts"), F.count_if(present()).alias("n"))
    each = ids.select(axis).join(sums, axis, "left").fillna(0, ["counts", "n"])
    c = F.col("counts" if name.endswith("counts") else "n")
    return each.withColumn("keep", c >= value if name.startswith("min") else c <= value)


def filter_samples(ds: SpatialDataset, *, min_counts=None, min_proteins=None, max_counts=None, max_proteins=None) -> SpatialDataset:
    """Samples by the sum of their values or the number of proteins detected; just one threshold."""
    each = _threshold(ds, "var_id", {"min_counts": min_counts, "min_proteins": min_proteins, "max_counts": max_counts, "max_proteins": max_proteins})
    return ds.keep_var(each.where("keep"))


def filter_proteins(ds: SpatialDataset, *, min_counts=None, min_samples=None, max_counts=None, max_samples=None, min_consecutive=None) -> SpatialDataset:
    """Proteins by the sum of their values or the number of samples they are detected in; just one threshold."""
    if min_consecutive is not None:
        raise ValueError("min_consecutive: use filter_min_consecutive_fractions")
    each = _threshold(ds, "obs_id", {"min_counts": min_counts, "min_samples": min_samples, "max_counts": max_counts, "max_samples": max_samples})
    return ds.keep_obs(each.where("keep"))


def longest_run(profile: Column) -> Column:
    """The longest run of values that are not 0 in an array; 0 for a null or empty one."""
    step = lambda acc, x: F.struct(
        F.when(F.coalesce(x, F.lit(0.0)) != 0, acc.cur + 1).otherwise(0).alias("cur"), F.greatest(acc.best, F.when(F.coalesce(x, F.lit(0.0)) != 0, acc.cur + 1).otherwise(0)).alias("best")
    )
    zero = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best"))
    return F.coalesce(F.aggregate(profile, zero, step, lambda acc: acc.best), F.lit(0))


def consecutive_runs(ds: SpatialDataset, group: str | None = None) -> DataFrame:
    """obs_id (, group), run: longest run of detected samples in their order, of each protein (and group of samples).

    Gaps and islands: where a protein is detected, the sample's place less its rank among the detected is the same
    along a run. Only detected cells are shuffled.
    """
    keys = ["obs_id"] + ([group] if group else [])
    var = ds.var.select("var_id", "var_pos", *([group] if group else []))
    place = F.row_number().over(Window.partitionBy(*([group] if group else [])).orderBy("var_pos", "var_id")) if group else F.row_number().over(Window.orderBy("var_pos", "var_id"))
    hits = ds.cells.where(present()).join(var.withColumn("place", place), "var_id")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    runs = hits.withColumn("island", F.col("place") - rank).groupBy(*keys, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("run"))


def filter_min_consecutive_fractions(ds: SpatialDataset, min_consecutive: int = 2, replicate_column: str | None = None, min_replicates: int | None = None) -> SpatialDataset:
    """Proteins detected in min_consecutive samples on end; with replicates, in at least min_replicates of them."""
    if replicate_column is not None and replicate_column not in ds.var.columns:
        raise ValueError(f"{replicate_column} is no column of var")
    if replicate_column is not None and min_replicates is None:
        raise ValueError("min_replicates must be given with replicate_column")
    ok = consecutive_runs(ds, replicate_column).where(F.col("run") >= min_consecutive)
    if replicate_column is not None:
        ok = ok.where(F.col(replicate_column).isNotNull()).groupBy("obs_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_replicates)
    return ds.keep_obs(ok)


def filter_proteins_per_replicate(ds: SpatialDataset, grouping_columns: list[str], min_replicates: int = 1, min_samples: int = 1) -> SpatialDataset:
    """Proteins detected in min_replicates samples of a group, in at least min_samples groups; null groups don't count."""
    groups = ds.var.dropna(subset=grouping_columns).select("var_id", *grouping_columns)
    n = ds.cells.where(present()).join(groups, "var_id").groupBy("obs_id", *grouping_columns).agg(F.count("*").alias("n")).where(F.col("n") >= min_replicates)
    return ds.keep_obs(n.groupBy("obs_id").agg(F.count("*").alias("g")).where(F.col("g") >= min_samples))


def remove_contaminants(ds: SpatialDataset, filter_columns: list[str] | None = None, filter_value: str | None = None) -> SpatialDataset:
    """Drops proteins flagged in any of the columns; with filter_value, flagged means equal to it."""
    columns = filter_columns or ds.uns.get("RawInfo", {}).get("filter_columns")
    if not columns:
        raise ValueError("no filter columns")
    flag = F.lit(False)
    for c in columns:
        one = F.col(c) == filter_value if filter_value is not None else F.col(c).cast("boolean")
        flag = flag | F.coalesce(one, F.lit(False))
    return ds.keep_obs(ds.obs.where(~flag))


def remove_listed(ds: SpatialDataset, listed: DataFrame, id_column: str = "obs_id", listed_column: str = "id") -> SpatialDataset:
    """Drops proteins whose accession (before the first '-') is in the list; where none or all are, nothing changes."""
    base = F.split(F.col(id_column), "-")[0]
    hit = ds.obs.select("obs_id", base.alias("acc")).join(broadcast_if_small(listed.select(F.col(listed_column).alias("acc")).distinct()), "acc", "left_semi")
    n, hits = ds.obs.count(), hit.count()
    if hits in (0, n):
        return ds
    return ds.keep_obs(ds.obs.join(hit.select("obs_id"), "obs_id", "left_anti"))


def drop_metadata(ds: SpatialDataset, colname_regex: str) -> SpatialDataset:
    """Drops obs columns whose name begins with a match of the pattern; keys stay."""
    pat = re.compile(colname_regex)
    return ds.with_(obs=ds.obs.drop(*[c for c in ds.obs.columns if pat.match(c) and c not in ("obs_id", "obs_pos")]))


def class_balance(ds: SpatialDataset, label_key: str, min_class_size: int = 10, seed: int = 42) -> SpatialDataset:
    """As many proteins of each label as the smallest label has, drawn by a hash of id and seed."""
    labelled = ds.obs.where(F.col(label_key).isNotNull()).select("obs_id", label_key)
    sizes = labelled.groupBy(label_key).count().agg(F.min("count")).first()[0] or 0
    if sizes < min_class_size:
        raise ValueError(f"the smallest class has {sizes} members")
    rank = F.row_number().over(Window.partitionBy(label_key).orderBy(F.xxhash64("obs_id", F.lit(seed)), "obs_id"))
    return ds.keep_obs(labelled.withColumn("r", rank).where(F.col("r") <= sizes))


def unknown_to_null(df: DataFrame, columns: list[str] | None = None, sentinel: str = "unknown") -> DataFrame:
    """Text columns with the sentinel as null; other columns as they are."""
    text = [c for c, t in df.dtypes if t == "string" and (columns is None or c in columns)]
    return df.select(*[F.when(F.col(c) != sentinel, F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


def align_datasets(data: list[SpatialDataset], intersect_obs: bool = True, intersect_var: bool = True) -> list[SpatialDataset]:
    """Each bundle with the proteins (and samples) that all of them have."""
    if intersect_obs:
        keys = data[0].obs.select("obs_id")
        for d in data[1:]:
            keys = keys.intersect(d.obs.select("obs_id"))
        data = [d.keep_obs(keys) for d in data]
    if intersect_var:
        keys = data[0].var.select("var_id")
        for d in data[1:]:
            keys = keys.intersect(d.var.select("var_id"))
        data = [d.keep_var(keys) for d in data]
    return data
