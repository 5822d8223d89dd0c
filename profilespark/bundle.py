"""The annotated matrix as a bundle of DataFrames: long cells, row and column tables, score matrices, edges, side data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilespark.session import read_table


def present(c: Column | str = "x") -> Column:
    """A measured value: neither null nor NaN nor 0."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (c != 0)


def measured(c: Column | str = "x") -> Column:
    """The value where it is measured, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(present(c), c)


@dataclass(frozen=True)
class SpatialDataset:
    """cells(obs_id, var_id, x, layers...), obs(obs_id, obs_pos, ...), var(var_id, var_pos, ...), scores, edges, uns.

    Every operation returns a new bundle. A cell without a row is missing like a null one.
    """

    cells: DataFrame
    obs: DataFrame
    var: DataFrame
    scores: DataFrame | None = None  # obs_id, key, category, value
    edges: DataFrame | None = None  # src, dst, w
    uns: dict = field(default_factory=dict)

    def with_(self, **parts) -> SpatialDataset:
        return replace(self, **parts)

    def keep_obs(self, ids: DataFrame) -> SpatialDataset:
        """The rows whose obs_id is in ids; edges keep those with both ends."""
        ids = ids.select("obs_id").distinct()
        semi = lambda df: df.join(ids, "obs_id", "left_semi") if df is not None else None
        edges = self.edges
        if edges is not None:
            edges = edges.join(ids.withColumnRenamed("obs_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("obs_id", "dst"), "dst", "left_semi")
        return self.with_(cells=semi(self.cells), obs=semi(self.obs), scores=semi(self.scores), edges=edges)

    def keep_var(self, ids: DataFrame) -> SpatialDataset:
        ids = ids.select("var_id").distinct()
        return self.with_(cells=self.cells.join(ids, "var_id", "left_semi"), var=self.var.join(ids, "var_id", "left_semi"))

    def profiles(self, value: str = "x", order: str = "var_pos") -> DataFrame:
        """obs_id, profile: the values in the order of the samples, missing ones as 0."""
        pos = self.var.select("var_id", F.col(order).alias("_o"))
        rows = self.cells.join(pos, "var_id").groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("_o", "var_id", F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias("v")))).alias("p"))
        return rows.select("obs_id", F.transform("p", lambda s: s.v).alias("profile"))

    def layer_names(self) -> list[str]:
        return [c for c in self.cells.columns if c not in ("obs_id", "var_id", "x")]

    def set_matrix(self, key: str, matrix: DataFrame) -> SpatialDataset:
        """Adds a labelled matrix obs_id, category, value under a key, in place of an older one of that key."""
        twice = matrix.groupBy("obs_id", "category").count().where("count > 1").limit(1).count()
        if twice:
            raise ValueError("labels of a matrix must be unique")
        new = matrix.select("obs_id", F.lit(key).alias("key"), F.col("category").cast("string").alias("category"), F.col("value").cast("double").alias("value"))
        old = self.scores.where(F.col("key") != key) if self.scores is not None else None
        return self.with_(scores=new if old is None else old.unionByName(new))

    def get_matrix(self, key: str) -> DataFrame:
        if self.scores is None:
            raise KeyError(key)
        return self.scores.where(F.col("key") == key).select("obs_id", "category", "value")

    def write_parquet(self, path: str, overwrite: bool = False) -> None:
        mode = "overwrite" if overwrite else "errorifexists"
        for name in ("cells", "obs", "var", "scores", "edges"):
            df = getattr(self, name)
            if df is not None:
                df.write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str) -> SpatialDataset:
        parts = {n: spark.read.parquet(f"{path}/{n}") for n in ("cells", "obs", "var")}
        for n in ("scores", "edges"):
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")
            written = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
            parts[n] = spark.read.parquet(f"{path}/{n}") if written else None
        return cls(**parts)


def dataset_tables(spark: SparkSession, d: str) -> SpatialDataset:
    """The test tables as a bundle: one row per protein and sample, current cells of the first injection."""
    from profilespark.operators.fill import latest

    obs = read_table(spark, d, "proteins").where("obs_id IS NOT NULL").distinct()
    var = read_table(spark, d, "samples").where("var_id IS NOT NULL").distinct()
    cells = latest(read_table(spark, d, "cells").where("injection = 1"), ["obs_id", "var_id"], "loaded_at", "x")
    edges = read_table(spark, d, "connectivities").select("src", "dst", "w")
    return SpatialDataset(cells, obs, var, edges=edges)


def diff_bundles(a: SpatialDataset, b: SpatialDataset, check_dtypes: bool = True) -> list[tuple[str, str, str]]:
    """(slot, column, added/removed/changed): which columns of which part differ in being there or in their type."""
    out = []
    for slot in ("cells", "obs", "var", "scores", "edges"):
        x, y = ({} if p is None else dict(p.dtypes) for p in (getattr(a, slot), getattr(b, slot)))
        for c in sorted(x.keys() | y.keys()):
            if c not in x:
                out.append((slot, c, "added"))
            elif c not in y:
                out.append((slot, c, "removed"))
            elif check_dtypes and x[c] != y[c]:
                out.append((slot, c, "changed"))
    for c in sorted(a.uns.keys() | b.uns.keys()):
        if a.uns.get(c) != b.uns.get(c):
            out.append(("uns", c, "added" if c not in a.uns else "removed" if c not in b.uns else "changed"))
    return out
