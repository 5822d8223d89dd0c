"""Missing values filled from records of the same entity, in order of time, each filled value marked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilespark.session import Scratch

#: What stands for nothing in a label once letters and digits alone are kept (fixed values).
NOTHING = (
    "na", "nan", "none", "null", "nil", "unknown", "unk", "unspecified", "undefined", "undetermined", "missing", "empty", "blank",
    "tbd", "tbc", "tba", "todo", "pending", "notrecorded", "notstated", "notspecified", "notavailable", "notapplicable", "notassigned",
    "notdetermined", "notknown", "nd", "norecord", "novalue", "x", "xx", "xxx",
)

DAY = 86_400
#: Rows of an entity that one task may put in order.
HOT_ROWS = 200_000


def states_nothing(c: Column, stand_ins: Sequence[str] = NOTHING) -> Column:
    """Null, blank, punctuation only, or one of the stand-ins for nothing in any letter case."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return c.isNull() | (bare == "") | bare.isin(*stand_ins)


def missing_number(c: Column) -> Column:
    """Null, NaN or zero."""
    return c.isNull() | F.isnan(c) | (c == 0)


def latest(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Of each key the value with the latest time; of equal times the larger one; a null time is the earliest.

    One aggregation with partial sums on the map side, so a key with many versions is reduced before the shuffle.
    """
    newest = F.max(F.struct(F.coalesce(F.col(at), F.timestamp_micros(F.lit(-62135596800000000))).alias("at"), F.col(value).alias("v")))
    return df.groupBy(*keys).agg(newest.alias("_n")).select(*keys, F.col("_n.v").alias(value))


def _beside(rows: DataFrame, part: list[str], tie: str, seen: Column) -> DataFrame:
    """The rows with the observed record before (_p) and after (_n) each within its part.

    What is observed is put together after the rows are brought together, so it doesn't cross the network.
    """
    inside = Window.partitionBy(*part).orderBy("_t", tie)
    rows = rows.repartition(*part).withColumn("_seen", seen)
    rows = rows.withColumn("_p", F.last("_seen", True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("_n", F.first("_seen", True).over(inside.rowsBetween(1, Window.unboundedFollowing))).drop("_seen")


def fill_in_time(
    df: DataFrame,
    entity: list[str],
    at: str,
    tie: str,
    value: str,
    absent: Column,
    numeric: bool,
    max_gap_s: int | None = None,
    chunk_s: int = DAY,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds <value>_filled, fill_method, fill_distance_s and fill_source (the tie column of the records used).

    Numbers between two observed records are interpolated in time; at the ends the nearest record is carried.
    Categories are carried from the last record within max_gap_s, else from the next one within it. Where only
    records beyond the gap limit exist, the nearest of them is carried as "beyond_gap", so that the caller may
    refuse it. Methods: observed, interpolated, carried_forward, carried_backward, beyond_gap, unfilled.

    An entity may hold a large part of all rows, so the rows of an entity of more than ``hot_rows`` are never put in order
    in one task: they are ordered within chunks of chunk_s seconds, and what is last and first in a chunk is passed on
    over one row per chunk. df is read twice, first to count the rows of entities. Rows without a time are taken as of
    the epoch. A record whose entity has a null is never filled.
    """
    whole = F.lit(True)
    for c in entity:
        whole = whole & F.col(c).isNotNull()
    ts = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(0))
    seen = F.when(~absent, F.struct(F.col("_t").alias("t"), F.col(tie).alias("id"), F.col(value).alias("v")))
    same = lambda other: [df[c].eqNullSafe(other[f"_k{i}"]) for i, c in enumerate(entity)]
    hot = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(entity)]).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows).drop("_rows")
    hot = Scratch(df.sparkSession, "hot").write(hot)  # at most a row for every hot_rows rows
    if hot.isEmpty():
        rows = _beside(df.withColumn("_t", ts), entity, tie, seen)
    else:
        cold = _beside(df.join(F.broadcast(hot), same(hot), "left_anti").withColumn("_t", ts), entity, tie, seen)
        many = df.join(F.broadcast(hot), same(hot), "left_semi").withColumn("_t", ts).withColumn("_chunk", F.floor(F.col("_t") / (chunk_s * 1_000_000)))
        part = [*entity, "_chunk"]
        rows = _beside(many, part, tie, seen)
        present = many.groupBy(*part).agg(F.min(seen).alias("_first"), F.max(seen).alias("_last"))
        across = Window.partitionBy(*entity).orderBy("_chunk")
        present = present.select(
            *[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)],
            F.last("_last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_pc"),
            F.first("_first", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_nc"),
        )
        rows = rows.join(present, [rows[c].eqNullSafe(present[f"_k{i}"]) for i, c in enumerate(part)], "left")
        rows = rows.withColumn("_p", F.coalesce("_p", "_pc")).withColumn("_n", F.coalesce("_n", "_nc"))
        rows = cold.unionByName(rows.select(*cold.columns))

    dp, dn = F.col("_t") - F.col("_p.t"), F.col("_n.t") - F.col("_t")
    limit = F.lit(2**62 if max_gap_s is None else max_gap_s * 1_000_000)
    near_p, near_n = dp <= limit, dn <= limit
    closer_p = F.col("_n").isNull() | (F.col("_p").isNotNull() & (dp <= dn))
    method = F.when(~absent, "observed").when(~whole, "unfilled")
    if numeric:
        method = method.when(near_p & near_n, "interpolated")
    method = method.when(near_p, "carried_forward").when(near_n, "carried_backward")
    method = F.coalesce(method, F.when(F.coalesce(F.col("_p"), F.col("_n")).isNotNull(), F.lit("beyond_gap")), F.lit("unfilled"))
    rows = rows.withColumn("fill_method", method)
    m = F.col("fill_method")
    nearest = F.when(closer_p, F.col("_p.v")).otherwise(F.col("_n.v"))
    filled = F.when(m == "observed", F.col(value))
    if numeric:
        share = F.when(dp + dn > 0, dp / (dp + dn)).otherwise(0.5)
        filled = filled.when(m == "interpolated", F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * share)
    filled = filled.when(m == "carried_forward", F.col("_p.v")).when(m == "carried_backward", F.col("_n.v")).when(m == "beyond_gap", nearest)
    dist = F.when(m == "interpolated", F.least(dp, dn)).when(m == "carried_forward", dp).when(m == "carried_backward", dn).when(m == "beyond_gap", F.least(dp, dn))
    source = F.when(m == "interpolated", F.array("_p.id", "_n.id")).when(m == "carried_forward", F.array("_p.id")).when(m == "carried_backward", F.array("_n.id"))
    source = source.when(m == "beyond_gap", F.array(F.when(closer_p, F.col("_p.id")).otherwise(F.col("_n.id"))))
    rows = rows.withColumn(f"{value}_filled", filled).withColumn("fill_distance_s", dist / 1_000_000).withColumn("fill_source", source)
    return rows.select(*df.columns, f"{value}_filled", "fill_method", "fill_distance_s", "fill_source")


def design(samples: DataFrame) -> DataFrame:
    """The design table, one row per sample: of rows with the same var_id the one registered last."""
    cols = ["dataset", "covariate_bait", "subcellular_enrichment", "acquired_at", "registered_at"]
    newest = F.max(F.struct(F.coalesce("registered_at", F.timestamp_micros(F.lit(0))).alias("r"), *cols[:4]))
    return samples.where(F.col("var_id").isNotNull()).groupBy("var_id").agg(newest.alias("s")).select("var_id", *[F.col(f"s.{c}").alias(c) for c in cols[:4]])


def fill_cells(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """The current cells of samples with a bait, their missing x filled from the bait's other samples in the dataset.

    Entity: protein, dataset, bait; order: acquired_at. The shared reference sample has no bait and is dropped
    by the join before anything is shuffled on the entity.
    """
    baited = design(samples).where(F.col("covariate_bait").isNotNull() & F.col("dataset").isNotNull())
    now = latest(cells.select("obs_id", "var_id", "injection", "x", "loaded_at").join(baited.select("var_id"), "var_id", "left_semi"), ["obs_id", "var_id", "injection"], "loaded_at", "x")
    rows = Scratch(cells.sparkSession, "fill").write(now.join(baited.drop("subcellular_enrichment"), "var_id"))  # read twice
    return fill_in_time(rows, ["obs_id", "dataset", "covariate_bait"], "acquired_at", "var_id", "x", missing_number(F.col("x")), numeric=True)


def fill_design(samples: DataFrame, max_gap_s: int = 30 * DAY, stand_ins: Sequence[str] = NOTHING) -> DataFrame:
    """The design table, its unstated enrichment targets carried from the bait's other samples in the dataset.

    ``stand_ins`` are the words that state nothing; where one of them is a target, the caller gives a list without it.
    """
    return fill_in_time(
        design(samples), ["dataset", "covariate_bait"], "acquired_at", "var_id", "subcellular_enrichment", states_nothing(F.col("subcellular_enrichment"), stand_ins), numeric=False, max_gap_s=max_gap_s, chunk_s=7 * DAY
    )


def filled_cases(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """field_name, obs_id, var_id of every value that fill_cells and fill_design filled."""
    filled = ~F.col("fill_method").isin("observed", "unfilled")
    x = fill_cells(cells, samples).where(filled).select(F.lit("x").alias("field_name"), "obs_id", "var_id").distinct()
    e = fill_design(samples).where(filled).select(F.lit("subcellular_enrichment").alias("field_name"), F.lit("").alias("obs_id"), "var_id")
    return x.unionByName(e)
