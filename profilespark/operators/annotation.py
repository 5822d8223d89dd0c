"""Annotations of proteins: marker joins, ontology roots, locations in JSON, feature notes, colours."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilespark.bundle import SpatialDataset
from profilespark.session import Scratch, broadcast_if_small

#: Colours of compartments (fixed values), and those that other labels get in turn.
COLOURS = {"cytosol": "#cfa56e", "nucleus": "#4b2e83", "mitochondria": "#c0392b", "er": "#2e86c1", "golgi": "#28b463", "lysosome": "#7d3c98", "peroxisome": "#d4ac0d", "plasma membrane": "#148f77"}
FALLBACK = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf"]


def best_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: that with the fewest nulls, then the first in order."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(nulls, order))
    return df.where(F.col(key).isNotNull()).withColumn("_r", rank).where("_r = 1").drop("_r")


def add_markers(ds: SpatialDataset, markers: DataFrame, authors: list[str] | None = None, id_column: str = "obs_id") -> SpatialDataset:
    """obs with the marker columns of the authors, joined on the accession; a column that is there already is an error."""
    cols = [c for c in markers.columns if c.startswith("marker_")]
    if authors is not None:
        missing = [a for a in authors if f"marker_{a}" not in cols]
        cols = [f"marker_{a}" for a in authors if f"marker_{a}" in cols]
        if not cols:
            raise ValueError(f"none of {authors} in the marker table")
        if missing:
            warnings.warn(f"no markers by {missing}", stacklevel=2)
    clash = [c for c in cols if c in ds.obs.columns]
    if clash:
        raise ValueError(f"obs has {clash} already")
    m = markers.select(F.col("id").alias("_id"), *cols).where("_id IS NOT NULL").dropDuplicates(["_id"])
    return ds.with_(obs=ds.obs.join(broadcast_if_small(m), ds.obs[id_column] == F.col("_id"), "left").drop("_id"))


def add_validation_markers(ds: SpatialDataset, table: DataFrame, columns: list[str] | None = None, id_column: str = "obs_id", ignore_isoforms: bool = False, use_genes: bool = False, gene_column: str = "gene_names") -> SpatialDataset:
    """obs with columns of a validation table, by accession (optionally without -n) or by gene, one row per gene."""
    columns = columns or [c for c in table.columns if c not in ("id", "gene_name")]
    key = "gene_name" if use_genes else "id"
    t = best_rows(table, key, "id").select(F.col(key).alias("_k"), *columns)
    at = F.col(gene_column) if use_genes else F.col(id_column)
    if ignore_isoforms and not use_genes:
        at = F.regexp_replace(at, r"-\d+$", "")
    clash = [c for c in columns if c in ds.obs.columns]
    if clash:
        raise ValueError(f"obs has {clash} already")
    return ds.with_(obs=ds.obs.withColumn("_at", F.trim(at)).join(broadcast_if_small(t), F.col("_at") == F.col("_k"), "left").drop("_at", "_k"))


def ontology_edges(terms: DataFrame, relationship: str = "hp") -> DataFrame:
    """child, parent by accession; parents are named by id, and a name no term has gives none."""
    names = terms.select(F.col("id").alias("name"), F.col("ac").alias("parent"))
    return terms.select(F.col("ac").alias("child"), F.explode(relationship).alias("name")).join(names, "name").select("child", "parent").distinct()


def find_roots(terms: DataFrame, relationship: str = "hp", starts: DataFrame | None = None, most_steps: int = 1000) -> DataFrame:
    """ac, root: what each term reaches upwards that has no parent. Cycles end, as a pair is followed once; a longer
    way than ``most_steps`` raises."""
    scratch = Scratch(terms.sparkSession, "roots")
    up = scratch.write(ontology_edges(terms, relationship))
    seen = scratch.write((starts.select("ac") if starts is not None else terms.select("ac")).distinct().select("ac", F.col("ac").alias("at")))
    new = seen
    for _ in range(most_steps):
        step = new.join(up, F.col("at") == F.col("child")).select("ac", F.col("parent").alias("at")).distinct().join(seen, ["ac", "at"], "left_anti")
        new = scratch.write(step)
        if new.isEmpty():
            break
        seen = scratch.write(seen.unionByName(new))
    else:
        raise RuntimeError(f"terms lead on after {most_steps} steps")
    return seen.join(up.select(F.col("child").alias("at")).distinct(), "at", "left_anti").select("ac", F.col("at").alias("root"))


LOCATIONS = "array<struct<commentType:string,molecule:string,subcellularLocations:array<struct<location:struct<value:string,id:string>>>>>"


def parse_locations(entries: DataFrame, terms: DataFrame, json_column: str = "comments") -> DataFrame:
    """obs_id, pos, location, ac, primary: subcellular locations of JSON comments, those of a molecule passed over.

    A location without an id is looked up by name.
    """
    c = entries.select("obs_id", F.posexplode(F.from_json(json_column, LOCATIONS)).alias("cp", "c")).where("c.commentType = 'SUBCELLULAR LOCATION' AND c.molecule IS NULL")
    loc = c.select("obs_id", "cp", F.posexplode("c.subcellularLocations").alias("lp", "l")).select("obs_id", "cp", "lp", F.col("l.location.value").alias("value"), F.col("l.location.id").alias("ac"))
    first, last = F.trim(F.split("value", ",")[0]), F.trim(F.element_at(F.split("value", ","), -1))
    loc = loc.withColumn("first", first).withColumn("last", last)
    names = broadcast_if_small(terms.select(F.col("id").alias("_n"), F.col("ac").alias("_ac")))
    j = loc.join(names, F.col("value") == F.col("_n"), "left").withColumn("ac", F.coalesce("ac", "_ac")).drop("_n", "_ac")
    pos = F.row_number().over(Window.partitionBy("obs_id").orderBy("cp", "lp"))
    return j.select("obs_id", pos.alias("pos"), F.coalesce("first", "value").alias("coarse"), F.coalesce("last", "value").alias("fine"), "ac")


def annotate_locations(entries: DataFrame, terms: DataFrame, multi: bool = True) -> DataFrame:
    """obs_id, coarse, fine of the first location (, all: the distinct coarse ones in order)."""
    p = parse_locations(entries, terms)
    one = p.groupBy("obs_id").agg(F.min_by("coarse", "pos").alias("coarse"), F.min_by("fine", "pos").alias("fine"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "coarse"))), lambda s: s.coarse)), ", ").alias("all_locations"))
    return one if multi else one.drop("all_locations")


def feature_notes(c: Column) -> Column:
    """The distinct /note="..." of a feature string, each up to '; Name=', joined by '; '; null where there is none."""
    notes = F.transform(F.regexp_extract_all(c, F.lit(r'/note="([^"]*)"'), F.lit(1)), lambda n: F.regexp_replace(n, "; Name=.*$", ""))
    return F.when(F.size(notes) > 0, F.array_join(F.array_distinct(notes), "; "))


def presence_flag(c: Column) -> Column:
    """True where there is text, else null, never false."""
    return F.when(F.trim(c) != "", F.lit(True))


def natural_key(c: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits order as numbers."""
    padded = F.regexp_replace(c, r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, r"0*(\d{%d})(?!\d)" % width, "$1")


def compartment_colours(labels: DataFrame, known: dict[str, str] | None = None, cutoff: float = 0.3) -> DataFrame:
    """label, colour: known names (lower case, _ as space) get theirs if at least the cutoff share is known; others the
    first free ones in turn. Labels are few; their table goes through one ordered window."""
    known = known or COLOURS
    key = F.lower(F.replace("label", F.lit("_"), F.lit(" ")))
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    rows = labels.where("label IS NOT NULL").select("label").distinct().withColumn("colour", table[key])
    share = rows.agg(F.avg(F.col("colour").isNotNull().cast("int")).alias("s"))
    rows = rows.join(F.broadcast(share)).withColumn("colour", F.when(F.col("s") >= cutoff, F.col("colour")))
    turn = F.sum(F.col("colour").isNull().cast("int")).over(Window.orderBy("label"))
    spare = F.array(*[F.lit(c) for c in FALLBACK])
    return rows.select("label", F.coalesce("colour", F.element_at(spare, F.pmod(turn - 1, F.lit(len(FALLBACK))).cast("int") + 1)).alias("colour"))


def create_external_markers(features: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Feature flags left-joined with two score tables on id; gene_name is the first that is not null; rows with any flag."""
    j = features.join(first.withColumnRenamed("gene_name", "_g1"), "id", "left").join(second.withColumnRenamed("gene_name", "_g2"), "id", "left")
    have = "gene_name" in features.columns
    j = j.withColumn("gene_name", F.coalesce(*([F.col("gene_name")] if have else []), "_g1", "_g2")).drop("_g1", "_g2")
    flags = [c for c in j.columns if c.startswith("has_")]
    keep = F.lit(False)
    for c in flags:
        keep = keep | F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    return j.where(keep)


def validate_table(df: DataFrame, key: str, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """check, column, n: how many rows break uniqueness of the key or the allowed values of a column, and null shares."""
    twice = df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated").alias("check"), F.lit(key).alias("column"), "n")
    out = twice
    for c, values in (allowed or {}).items():
        out = out.unionByName(df.agg(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)).alias("n")).select(F.lit("not allowed").alias("check"), F.lit(c).alias("column"), "n"))
    return out
