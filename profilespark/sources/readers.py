"""Files to DataFrames and bundles: search-engine tables, gene sets, marker tables, vocabularies, R-style exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profilespark.bundle import SpatialDataset


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)


def _wide(spark: SparkSession, path: str, id_column: str, value_columns: dict[str, str]) -> SpatialDataset:
    """A table with a row per protein and a column per sample; missing values are 0, other columns go to obs."""
    raw = _tsv(spark, path)
    if id_column not in raw.columns:
        raise ValueError(f"{path} has no column {id_column}")
    if not value_columns:
        raise ValueError(f"{path} has no intensity columns")
    quoted = {c: f"`{c}`" for c in raw.columns}
    raw = raw.withColumn("obs_id", F.col(quoted[id_column]))
    long = raw.select("obs_id", F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in value_columns.values()]), F.array(*[F.col(quoted[c]).cast("double") for c in value_columns]))).alias("var_id", "x"))
    cells = long.select("obs_id", "var_id", F.coalesce(F.nanvl("x", F.lit(0.0)), F.lit(0.0)).alias("x"))
    obs = raw.select("obs_id", F.monotonically_increasing_id().alias("obs_pos"), *[F.col(quoted[c]).alias(re.sub(r"\W+", "_", c).strip("_")) for c in raw.columns if c not in value_columns and c != "obs_id"])
    var = spark.createDataFrame([(s, i) for i, s in enumerate(value_columns.values())], "var_id string, var_pos int")
    return SpatialDataset(cells, obs, var)


def read_maxquant(spark: SparkSession, path: str, id_column: str = "Protein IDs", prefix: str = "LFQ intensity ") -> SpatialDataset:
    """proteinGroups.txt: the columns that begin with the prefix are samples."""
    cols = _tsv(spark, path).columns
    return _wide(spark, path, id_column, {c: c[len(prefix) :] for c in cols if c.startswith(prefix)})


def read_fragpipe(spark: SparkSession, path: str, id_column: str = "Protein", suffix: str = " MaxLFQ Intensity") -> SpatialDataset:
    """combined_protein.tsv: the columns that end with the suffix are samples."""
    cols = _tsv(spark, path).columns
    return _wide(spark, path, id_column, {c: c[: -len(suffix)] for c in cols if c.endswith(suffix)})


def read_diann(spark: SparkSession, path: str, protein: str = "Protein.Group", run: str = "Run", value: str = "PG.MaxLFQ") -> SpatialDataset:
    """report.tsv, which is long: one value per protein and run, the first of equal keys by size."""
    raw = _tsv(spark, path).select(F.col(f"`{protein}`").alias("obs_id"), F.col(f"`{run}`").alias("var_id"), F.col(f"`{value}`").cast("double").alias("x"))
    cells = raw.where("obs_id IS NOT NULL AND var_id IS NOT NULL").groupBy("obs_id", "var_id").agg(F.coalesce(F.max(F.when(~F.isnan("x"), F.col("x"))), F.lit(0.0)).alias("x"))
    obs = cells.select("obs_id").distinct().withColumn("obs_pos", F.monotonically_increasing_id())
    var = cells.select("var_id").distinct().withColumn("var_pos", F.row_number().over(Window.orderBy("var_id")) - 1)
    return SpatialDataset(cells, obs, var)


def read_gmt(spark: SparkSession, path: str, deduplicate: bool = True) -> DataFrame:
    """term, gene: lines of term, source, genes...; shorter lines are skipped; the last line of a term counts.

    deduplicate: of terms with the same genes the first in the file stays.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    sets = lines.select("pos", F.col("f")[0].alias("term"), F.array_sort(F.array_distinct(F.filter(F.slice("f", 3, 10_000_000), lambda g: F.trim(g) != ""))).alias("genes"))
    sets = sets.groupBy("term").agg(F.max_by("genes", "pos").alias("genes"), F.max("pos").alias("pos"))
    if deduplicate:
        sets = sets.groupBy("genes").agg(F.min_by("term", "pos").alias("term"))
    return sets.select("term", F.explode("genes").alias("gene"))


def gene_sets_from_mapping(spark: SparkSession, sets: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(t, g) for t, gs in sets.items() for g in gs], "term string, gene string")


def read_markers(spark: SparkSession, path: str, authors: list[str] | None = None) -> DataFrame:
    """id, marker_<author>...: a marker table; of the authors asked for, all missing is an error, some are passed over."""
    raw = _tsv(spark, path)
    cols = [c for c in raw.columns if c.startswith("marker_")]
    if authors is not None:
        cols = [f"marker_{a}" for a in authors if f"marker_{a}" in raw.columns]
        if not cols:
            raise ValueError(f"none of {authors} in {path}")
    return raw.select("id", *cols)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """ac, id, de, hi, hp, sy, go, sl of a flat file of records that end with //; a record needs ID and AC.

    The text before the first record line is skipped; lines of a field are joined; a final full stop goes.
    """
    lines = F.transform(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda s: F.struct(F.substring(s, 1, 2).alias("k"), F.trim(F.substring(s, 6, 100_000)).alias("v")))
    rec = spark.read.option("lineSep", "//\n").text(path).select(lines.alias("l"))
    of = lambda *ks: F.transform(F.filter("l", lambda s: s.k.isin(*ks)), lambda s: F.regexp_replace(s.v, r"\.$", ""))
    one = lambda *ks: F.get(of(*ks), 0)
    de = F.regexp_replace(F.array_join(F.transform(F.filter("l", lambda s: s.k == "DE"), lambda s: s.v), " "), r"\.$", "")
    sy = F.filter(F.transform(F.split(F.regexp_replace(F.array_join(F.transform(F.filter("l", lambda s: s.k == "SY"), lambda s: s.v), " "), r"\.$", ""), ";"), lambda x: F.trim(x)), lambda x: x != "")
    out = rec.select(one("AC").alias("ac"), one("ID", "IT", "IO").alias("id"), de.alias("de"), of("HI").alias("hi"), of("HP").alias("hp"), sy.alias("sy"), of("GO").alias("go"), one("SL").alias("sl"))
    return out.where("ac IS NOT NULL AND id IS NOT NULL")


def read_msnset_tables(spark: SparkSession, exprs: str, fdata: str, pdata: str, unknown_to_null: bool = True, replace_nan: bool = True) -> SpatialDataset:
    """An expression set exported as three tables: values (first column the feature), feature and sample data."""
    raw, f, p = _tsv(spark, exprs), _tsv(spark, fdata), _tsv(spark, pdata)
    fid, pid = f.columns[0], p.columns[0]
    samples = raw.columns[1:]
    long = raw.select(F.col(f"`{raw.columns[0]}`").alias("obs_id"), F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in samples]), F.array(*[F.col(f"`{s}`").cast("double") for s in samples]))).alias("var_id", "x"))
    cells = long.withColumn("x", F.coalesce(F.nanvl("x", F.lit(0.0)), F.lit(0.0))) if replace_nan else long
    rename = lambda df, key, name: df.select(F.col(f"`{key}`").alias(name), *[F.col(f"`{c}`").alias(re.sub(r"\W+", "_", c)) for c in df.columns[1:]])
    obs = rename(f, fid, "obs_id").withColumn("obs_pos", F.monotonically_increasing_id())
    if unknown_to_null:
        from profilespark.operators.filters import unknown_to_null as clean

        obs = clean(obs)
    if obs.groupBy("obs_id").count().where("count > 1 OR obs_id IS NULL OR obs_id = ''").limit(1).count():
        raise ValueError("feature names must be unique and not blank")
    return SpatialDataset(cells, obs, rename(p, pid, "var_id").withColumn("var_pos", F.monotonically_increasing_id()))


def write_msnset_tables(ds: SpatialDataset, path: str, columns: list[str] | None = None, drop: list[str] | None = None, nan_to_unknown: bool = True, overwrite: bool = False) -> None:
    """The reverse: exprs, fdata and pdata as tab-separated tables under a folder; an existing one is refused."""
    mode = "overwrite" if overwrite else "errorifexists"
    samples = [r[0] for r in ds.var.orderBy("var_pos", "var_id").select("var_id").collect()]
    wide = ds.cells.groupBy("obs_id").pivot("var_id", samples).agg(F.first("x"))
    keep = [c for c in (columns or ds.obs.columns) if c not in (drop or []) and c != "obs_id"]
    obs = ds.obs.select("obs_id", *keep)
    if nan_to_unknown:
        obs = obs.select("obs_id", *[F.coalesce(F.col(c), F.lit("unknown")).alias(c) if t == "string" else F.col(c) for c, t in obs.dtypes if c != "obs_id"])
    for name, df in (("exprs", wide), ("fdata", obs), ("pdata", ds.var)):
        df.write.mode(mode).option("sep", "\t").option("header", True).csv(f"{path}/{name}")


class Registry:
    """Named datasets under a root folder, each a bundle in parquet."""

    def __init__(self, spark: SparkSession, root: str, names: list[str]):
        self.spark, self.root, self.names = spark, root, names

    def load(self, name: str, enrichment: str = "enriched") -> SpatialDataset:
        if name not in self.names:
            raise ValueError(f"no dataset {name}; there are {', '.join(self.names)}")
        if enrichment not in ("enriched", "raw"):
            raise ValueError(enrichment)
        return SpatialDataset.read_parquet(self.spark, f"{self.root}/{enrichment}/{name}")


def without_controls(ds: SpatialDataset, include_untagged: bool = False, include_fractions: bool = False, include_proteome: bool = False) -> SpatialDataset:
    """The samples of an enrichment experiment without untagged, coarse-fraction and whole-proteome samples."""
    e, keep = F.col("subcellular_enrichment"), F.lit(True)
    if not include_untagged:
        keep = keep & (e != "UNTAGGED")
    if not include_fractions:
        keep = keep & ~e.isin("CYTOSOL", "NUCLEAR", "ORGANELLE")
    if not include_proteome:
        keep = keep & (e != "PROTEOME")
    return ds.keep_var(ds.var.where(F.coalesce(keep, F.lit(True))))
