"""Queries over packed fields and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilespark.operators.fill import NOTHING, fill_cells, fill_design, filled_cases
from profilespark.operators.packed import split_packed
from profilespark.session import read_table

PACKED = ["simplified_protein_ids", "protein_ids"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    values = split_packed(read_table(spark, d, "mitocop"), "record_id", PACKED, "protein_id")
    return values.where("n_values >= 2").select("record_id", "field_name", "pos", "protein_id")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value, single ones too, with the alternative that read it."""
    return split_packed(read_table(spark, d, "mitocop"), "record_id", PACKED, "protein_id").select("record_id", "field_name", "pos", "protein_id", "kind")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return filled_cases(read_table(spark, d, "cells"), read_table(spark, d, "samples"))


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """The filled matrix: one row per current cell of a sample with a bait."""
    filled = fill_cells(read_table(spark, d, "cells"), read_table(spark, d, "samples"))
    return filled.select("obs_id", "var_id", "injection", F.round("x_filled", 6).alias("x_filled"), "fill_method")


def p4_design(spark: SparkSession, d: str) -> DataFrame:
    filled = fill_design(read_table(spark, d, "samples"))
    return filled.select("var_id", "subcellular_enrichment_filled", "fill_method", F.array_join("fill_source", ",").alias("fill_source"))


QUERIES = {"p3_found": p3_found, "p3_values": p3_values, "p4_found": p4_found, "p4_cells": p4_cells, "p4_design": p4_design}

_VALUES = r"""
WITH f AS (
  SELECT record_id, 'simplified_protein_ids' AS field_name, simplified_protein_ids AS s FROM mitocop
  UNION SELECT record_id, 'protein_ids', protein_ids FROM mitocop),
v AS (
  SELECT record_id, field_name, list_filter(list_transform(
    regexp_extract_all(s, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^;,|/+&\s]+'),
    lambda t: CASE WHEN t LIKE '"%"' THEN trim(replace(substr(t, 2, length(t) - 2), '""', '"'))
                   WHEN t LIKE '''%''' THEN trim(replace(substr(t, 2, length(t) - 2), '''''', '''')) ELSE t END),
    lambda t: t <> '') AS l,
    list_transform(regexp_extract_all(s, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^;,|/+&\s]+'),
    lambda t: CASE WHEN t LIKE '"%"' OR t LIKE '''%''' THEN 'quoted' WHEN t LIKE '%(%' THEN 'bracketed' ELSE 'bare' END) AS k
  FROM f WHERE s IS NOT NULL AND lower(trim(s)) NOT IN
    ('see parent', 'n/a', 'none', '-', '--', 'pending, ask curator', 'not assigned'))
"""

_CELLS = r"""
WITH s AS (SELECT DISTINCT var_id, dataset, covariate_bait, acquired_at FROM samples WHERE covariate_bait IS NOT NULL AND dataset IS NOT NULL),
c AS (SELECT obs_id, var_id, injection, x FROM cells
  QUALIFY row_number() OVER (PARTITION BY obs_id, var_id, injection ORDER BY loaded_at DESC NULLS LAST, x DESC NULLS LAST) = 1),
j AS (SELECT c.*, s.dataset, s.covariate_bait, epoch_us(coalesce(s.acquired_at, TIMESTAMP '1970-01-01')) AS t,
  CASE WHEN x IS NULL OR isnan(x) OR x = 0 THEN NULL ELSE x END AS v FROM c JOIN s USING (var_id)),
n AS (SELECT *, CASE WHEN v IS NOT NULL THEN {'t': t, 'v': v} END AS p FROM j),
w AS (SELECT *,
  last_value(p IGNORE NULLS) OVER (PARTITION BY obs_id, dataset, covariate_bait ORDER BY t, var_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(p IGNORE NULLS) OVER (PARTITION BY obs_id, dataset, covariate_bait ORDER BY t, var_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b
  FROM n)
"""

ORACLE = {
    "p3_found": _VALUES + "SELECT record_id, field_name, CAST(i AS INTEGER) AS pos, l[i] AS protein_id FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM v WHERE len(l) >= 2)",
    "p3_values": _VALUES + "SELECT record_id, field_name, CAST(i AS INTEGER) AS pos, l[i] AS protein_id, k[i] AS kind FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM v)",
    "p4_found": r"""
WITH s AS (SELECT DISTINCT var_id, dataset, covariate_bait, (subcellular_enrichment IS NULL
    OR regexp_replace(lower(subcellular_enrichment), '[^a-z0-9]', '', 'g') IN ('', 'na', 'nan', 'none', 'null', 'unknown', 'tbd', 'notrecorded')) AS nothing
  FROM samples WHERE covariate_bait IS NOT NULL AND dataset IS NOT NULL),
c AS (SELECT obs_id, var_id, injection, x FROM cells
  QUALIFY row_number() OVER (PARTITION BY obs_id, var_id, injection ORDER BY loaded_at DESC NULLS LAST) = 1),
j AS (SELECT obs_id, var_id, dataset, covariate_bait, (x IS NULL OR isnan(x) OR x = 0) AS miss FROM c JOIN s USING (var_id)),
has AS (SELECT obs_id, dataset, covariate_bait FROM j WHERE NOT miss GROUP BY ALL),
says AS (SELECT dataset, covariate_bait FROM s WHERE NOT nothing GROUP BY ALL)
SELECT DISTINCT 'x' AS field_name, obs_id, var_id FROM j JOIN has USING (obs_id, dataset, covariate_bait) WHERE miss
UNION ALL SELECT 'subcellular_enrichment', '', var_id FROM s JOIN says USING (dataset, covariate_bait) WHERE nothing""",
    "p4_cells": _CELLS + r"""
SELECT obs_id, var_id, injection, round(CASE WHEN v IS NOT NULL THEN v
    WHEN a IS NOT NULL AND b IS NOT NULL THEN a.v + (b.v - a.v) * (CASE WHEN b.t > a.t THEN (t - a.t) / (b.t - a.t) ELSE 0.5 END)
    ELSE coalesce(a.v, b.v) END, 6) AS x_filled,
  CASE WHEN v IS NOT NULL THEN 'observed' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'interpolated'
    WHEN a IS NOT NULL THEN 'carried_forward' WHEN b IS NOT NULL THEN 'carried_backward' ELSE 'unfilled' END AS fill_method FROM w""",
    "p4_design": r"""
WITH s AS (SELECT * FROM samples WHERE var_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY var_id ORDER BY coalesce(registered_at, TIMESTAMP '1970-01-01') DESC,
    dataset DESC NULLS LAST, covariate_bait DESC NULLS LAST, subcellular_enrichment DESC NULLS LAST, acquired_at DESC NULLS LAST) = 1),
d AS (SELECT var_id, dataset, covariate_bait, epoch_us(coalesce(acquired_at, TIMESTAMP '1970-01-01')) AS t,
    CASE WHEN regexp_replace(lower(subcellular_enrichment), '[^\p{L}\p{N}]', '', 'g') NOT IN ('', %s) THEN subcellular_enrichment END AS v FROM s),
n AS (SELECT *, CASE WHEN v IS NOT NULL THEN {'t': t, 'id': var_id, 'v': v} END AS p FROM d),
w AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY dataset, covariate_bait ORDER BY t, var_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
    first_value(p IGNORE NULLS) OVER (PARTITION BY dataset, covariate_bait ORDER BY t, var_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM n),
m AS (SELECT *, CASE WHEN v IS NOT NULL THEN 'observed' WHEN dataset IS NULL OR covariate_bait IS NULL THEN 'unfilled' WHEN t - a.t <= 2592000000000 THEN 'carried_forward'
    WHEN b.t - t <= 2592000000000 THEN 'carried_backward' WHEN a IS NOT NULL OR b IS NOT NULL THEN 'beyond_gap' ELSE 'unfilled' END AS fill_method,
    CASE WHEN b IS NULL OR (a IS NOT NULL AND t - a.t <= b.t - t) THEN a ELSE b END AS near FROM w)
SELECT var_id, fill_method, CASE fill_method WHEN 'observed' THEN v WHEN 'carried_forward' THEN a.v WHEN 'carried_backward' THEN b.v WHEN 'beyond_gap' THEN near.v END AS subcellular_enrichment_filled,
    CASE fill_method WHEN 'carried_forward' THEN a.id WHEN 'carried_backward' THEN b.id WHEN 'beyond_gap' THEN near.id END AS fill_source FROM m"""
    % ", ".join(f"'{w}'" for w in NOTHING),
}
