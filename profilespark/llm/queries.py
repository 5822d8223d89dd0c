"""Queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilespark.llm import communities as C
from profilespark.llm import neighbours as N
from profilespark.llm.canonical import ACCENT, EDITS, HEDGE, LOOKALIKE, map_labels, unmatched_report
from profilespark.llm.leaks import find_leaks
from profilespark.llm.packing import pack, packing_report
from profilespark.llm.pii import find_pii, redact_pii
from profilespark.session import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return N.similar_pairs(read_table(spark, d, "protein_pca"), "obs_id", "x_pca", 0.96)


#: What the whole graph is built with: lists of 20, of which 10 come out.
WHOLE = {"k": 20, "trees": 8, "leaf": 1000, "reverse": 24, "rounds": 10}


def p1_graph(spark: SparkSession, d: str) -> DataFrame:
    """The whole neighbour graph: the 10 most similar proteins of each, whatever their similarity."""
    graphs = N.build_graphs(read_table(spark, d, "protein_pca"), "obs_id", "x_pca", **WHOLE)
    return N.neighbours_of_all(graphs, 10).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.round("sim", 4).alias("similarity"), "rank")


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar proteins of every protein whose id's hash is divisible by 20, by greedy search in the graph of all."""
    all_ = read_table(spark, d, "protein_pca").select("obs_id", "x_pca")
    asked = N.unit_vectors(all_.where(F.pmod(F.xxhash64("obs_id"), F.lit(20)) == 0), "obs_id", "x_pca")
    found = [N.greedy_search(g, asked.where(F.col("dim") == g.dim).select("id", "vec"), k=10) for g in N.build_graphs(all_, "obs_id", "x_pca", **WHOLE)]
    return reduce(DataFrame.unionByName, found).select(F.col("query").alias("obs_id"), F.col("id").alias("other"), F.round("sim", 4).alias("similarity"), "rank")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return C.tied_clusters(read_table(spark, d, "proteins"), read_table(spark, d, "connectivities"))


def p2_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of all weighted edges, with their size and the three most typical members."""
    edges = C.strong_edges(read_table(spark, d, "proteins"), read_table(spark, d, "connectivities"), least=0.0).where("w > 0")
    return C.describe(edges, C.modularity_communities(edges)).withColumn("typical", F.array_join("typical", ","))


def p2_from_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Communities of a graph built by neighbour descent from the vectors, edges of similarity 0.75 or more."""
    edges = C.vector_edges(read_table(spark, d, "protein_pca"), "obs_id", "x_pca", 0.75)
    return C.describe(edges, C.modularity_communities(edges)).withColumn("typical", F.array_join("typical", ","))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return map_labels(read_table(spark, d, "proteins"), read_table(spark, d, "compartments")).select("field_name", "obs_id", "compartment_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unmatched_report(map_labels(read_table(spark, d, "proteins"), read_table(spark, d, "compartments")))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(read_table(spark, d, "documents"), read_table(spark, d, "token_budgets"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    budgets = read_table(spark, d, "token_budgets")
    return packing_report(pack(read_table(spark, d, "documents"), budgets), budgets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_spans(spark, d).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """The merged spans to remove from each document."""
    return find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    spans = find_pii(read_table(spark, d, "documents"), read_table(spark, d, "person_names"))
    return spans.select("doc_id", "kind", "pii_text").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_pii(read_table(spark, d, "documents"), read_table(spark, d, "person_names"))


QUERIES = {
    "p1_found": p1_found, "p1_graph": p1_graph, "p1_search": p1_search, "p2_found": p2_found, "p2_communities": p2_communities, "p2_from_vectors": p2_from_vectors,
    "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p6_pack": p6_pack, "p6_report": p6_report, "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found, "p8_redacted": p8_redacted,
}

# The same steps in DuckDB, but every value is held against every reference string: no segments, no cut of candidates.
_MAPPED = rf"""
WITH strings AS (SELECT DISTINCT ref_id, s, prim, regexp_replace(s, '[^a-z0-9]', '', 'g') AS key FROM (
    SELECT compartment_id AS ref_id, lower(translate(compartment, '{ACCENT[0]}', '{ACCENT[1]}')) AS s, true AS prim FROM compartments
    UNION ALL SELECT compartment_id, lower(translate(a, '{ACCENT[0]}', '{ACCENT[1]}')), false FROM (SELECT compartment_id, unnest(aliases) AS a FROM compartments))
  WHERE regexp_replace(s, '[^a-z0-9]', '', 'g') <> ''),
typed AS (SELECT DISTINCT field_name, obs_id, value FROM (SELECT 'markers' AS field_name, obs_id, markers AS value FROM proteins UNION ALL SELECT 'cell_compartment', obs_id, cell_compartment FROM proteins)
  WHERE obs_id IS NOT NULL AND regexp_replace(value, '\s', '', 'g') <> '' AND lower(trim(value)) <> 'unknown' AND value NOT IN (SELECT compartment FROM compartments WHERE compartment IS NOT NULL)),
v0 AS (SELECT value, regexp_replace(translate(lower(translate(value, '{LOOKALIKE[0]}', '{LOOKALIKE[1]}')), '{ACCENT[0]}', '{ACCENT[1]}'), '[(\[][^)\]]*[)\]]', ' ', 'g') AS c FROM (SELECT DISTINCT value FROM typed)),
v1 AS (SELECT value, regexp_replace(trim(regexp_replace(c, '\s+[-/|]\s+.*$', '', 'g')), '^(?:{HEDGE}\s+)+', '', 'g') AS c FROM v0),
v AS (SELECT value, regexp_replace(c, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS c FROM v1),
forms AS (SELECT DISTINCT value, c, regexp_replace(unnest([c, CASE WHEN c LIKE '%,%' THEN regexp_replace(c, '^([^,]*),(.*)$', '\2 \1') ELSE c END]), '[^a-z0-9]', '', 'g') AS key FROM v),
exact AS (SELECT value, min(ref_id) AS ref_id FROM forms JOIN strings USING (key) GROUP BY value),
vt AS (SELECT DISTINCT value, string_split_regex(replace(c, '-', ''), '\s+') AS t FROM forms WHERE value NOT IN (SELECT value FROM exact) AND regexp_matches(c, '[a-z]\.\s')),
rt AS (SELECT ref_id, string_split_regex(replace(s, '-', ''), '\s+') AS t FROM strings WHERE prim),
cut AS (SELECT value, min(ref_id) AS ref_id FROM vt JOIN rt ON len(vt.t) = len(rt.t) AND list_transform(vt.t, lambda x: x[1]) = list_transform(rt.t, lambda x: x[1])
  WHERE list_bool_and(list_transform(range(1, len(vt.t) + 1), lambda i: CASE WHEN vt.t[i] LIKE '%.' THEN starts_with(rt.t[i], rtrim(vt.t[i], '.')) ELSE levenshtein(vt.t[i], rt.t[i]) <= 1 END)) GROUP BY value),
s2 AS (SELECT *, {EDITS} AS k FROM (SELECT DISTINCT ref_id, key, length(key) AS n FROM strings)),
near AS (SELECT value, min(d * 1000000 + ref_id) % 1000000 AS ref_id FROM (SELECT f.value, s2.ref_id, levenshtein(f.key, s2.key) AS d, s2.k FROM forms f JOIN s2 ON abs(length(f.key) - s2.n) <= s2.k
    WHERE s2.k > 0 AND f.key <> '' AND f.value NOT IN (SELECT value FROM exact) AND f.value NOT IN (SELECT value FROM cut)) WHERE d <= k GROUP BY value),
mapped AS (SELECT * FROM exact UNION ALL SELECT * FROM cut UNION ALL SELECT * FROM near)
"""

ORACLE = {
    "p5_found": _MAPPED + "SELECT field_name, obs_id, CAST(coalesce(ref_id, 0) AS INTEGER) AS compartment_id FROM typed LEFT JOIN mapped USING (value)",
    "p5_unmatched": _MAPPED + "SELECT field_name, value, count(*) AS n FROM typed WHERE value NOT IN (SELECT value FROM mapped) GROUP BY field_name, value",
    "p1_found": r"""
WITH v AS (SELECT obs_id, CAST(x_pca AS DOUBLE[48]) AS x FROM (SELECT DISTINCT obs_id, x_pca FROM protein_pca WHERE x_pca IS NOT NULL AND list_sum(list_transform(x_pca, lambda t: abs(t))) > 0)),
p AS (SELECT a.obs_id AS u, b.obs_id AS v, array_cosine_similarity(a.x, b.x) AS s FROM v a JOIN v b ON a.obs_id <> b.obs_id),
r AS (SELECT u, v, s FROM p QUALIFY row_number() OVER (PARTITION BY u ORDER BY s DESC, v) <= 10)
SELECT DISTINCT least(u, v) AS obs_a, greatest(u, v) AS obs_b FROM r WHERE s >= 0.96""",
    "p2_found": r"""
WITH RECURSIVE e AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(w) AS w FROM connectivities
  WHERE src <> dst AND w IS NOT NULL AND src IN (SELECT obs_id FROM proteins) AND dst IN (SELECT obs_id FROM proteins) GROUP BY 1, 2),
s AS (SELECT u, v FROM e WHERE w >= 0.5), b AS (SELECT u, v FROM s UNION ALL SELECT v, u FROM s),
t AS (SELECT s.u, s.v FROM s JOIN b x ON x.u = s.u JOIN b y ON y.u = s.v AND y.v = x.v GROUP BY 1, 2 HAVING count(*) >= 2),
tb AS (SELECT u, v FROM t UNION ALL SELECT v, u FROM t),
reach AS (SELECT DISTINCT u AS a, u AS b FROM tb UNION SELECT r.a, tb.v FROM reach r JOIN tb ON tb.u = r.b),
c AS (SELECT a AS obs_id, min(b) AS cluster_obs_id, count(*) AS n FROM reach GROUP BY 1)
SELECT cluster_obs_id, obs_id FROM c WHERE n >= 4""",
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(strip_accents(replace(lower(passage), 'ß', 'ss')), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dp AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
ep AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dp JOIN ep USING (s)""",
}
