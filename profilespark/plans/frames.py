"""Queries over operators that give frames and tables beside the matrix, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilespark.bundle import dataset_tables
from profilespark.operators import annotation as N
from profilespark.operators import clusters as C
from profilespark.operators import labels as L
from profilespark.operators import metrics as M
from profilespark.operators import plotframes as P
from profilespark.operators import space as V
from profilespark.plans import matrix as X
from profilespark.plans.matrix import _B, _E, _G, _L, _P, _clusters, _gene_sets, _genes, _labels, _predicted, _vectors
from profilespark.session import read_table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return L.symmetric_edges(dataset_tables(spark, d).edges)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return L.propagate(_edges(spark, d), L.one_hot(_labels(spark, d, dataset_tables(spark, d))))


def knn_confusion_soft(spark, d):
    got = L.soft_confusion(_labels(spark, d, dataset_tables(spark, d)), _scores(spark, d))
    return got.withColumn("share", F.round("share", 5))


def true_class_probability(spark, d):
    """The frame behind the violins of a neighbour graph: each marker's score for its own class."""
    got = P.true_class_probability(_labels(spark, d, dataset_tables(spark, d)), _scores(spark, d))
    return got.withColumn("value", F.round("value", 6))


def nearest_neighbours(spark, d):
    """What is reached from the first protein in two steps along the five heaviest edges of each."""
    edges = _edges(spark, d)
    return L.nearest_neighbours(edges, edges.agg(F.min("src")).first()[0], order=2, n=5)


def relabel_edges(spark, d):
    ds = dataset_tables(spark, d)
    names = ds.obs.where("gene_name_canonical IS NOT NULL").select("obs_id", F.col("gene_name_canonical").alias("name"))
    return L.relabel_edges(L.symmetric_edges(ds.edges), names)


def rbf_weights(spark, d):
    e = _edges(spark, d).select("src", "dst", (1 - F.col("w")).alias("dist"))
    return L.rbf_weights(e).select("src", "dst", F.round("w", 8).alias("w"))


def pair_distances(spark, d):
    """Distances between the first 40 proteins, as a cluster map asks for: its names are the caller's."""
    v = _vectors(spark, d)
    names = [r.obs_id for r in v.select("obs_id").distinct().orderBy("obs_id").limit(40).collect()]
    return P.pair_distances(v, names).select("a", "b", F.round("distance", 4).alias("distance"))


def score_histogram(spark, d):
    return P.score_histogram(dataset_tables(spark, d).obs.select(F.col("n_peptides").cast("double").alias("score")), bins=16).select("bin", F.round("lo", 6).alias("lo"), "n")


def ternary(spark, d):
    """Shares of the first three samples of the first dataset."""
    ds = dataset_tables(spark, d)
    first = ds.var.where("dataset IS NOT NULL").orderBy("dataset", "var_pos", "var_id").limit(3)
    return P.ternary(ds.with_(var=first)).select("obs_id", *[F.round(c, 6).alias(c) for c in "abc"])


def feature_notes(spark, d):
    """Notes read from feature strings made of two fields."""
    f = F.concat(F.lit('FT /note="'), "dataset", F.lit('; Name=a"; /note="'), "gene_name_canonical", F.lit('"; /note="'), "dataset", F.lit('"'))
    return dataset_tables(spark, d).obs.select("obs_id", N.feature_notes(f).alias("notes"), N.presence_flag(F.col("potential_contaminant")).alias("flag"))


def imputed_counts(spark, d):
    """How many values each protein needs filled for every sample of its dataset."""
    return V.impute_gaussian(dataset_tables(spark, d)).obs.select("obs_id", "n_imputed")


def add_markers(spark, d):
    """Marker columns of one author joined on the accession; the table names each first protein of a typed value."""
    table = read_table(spark, d, "proteins").where("obs_id IS NOT NULL AND markers IS NOT NULL").groupBy(F.col("obs_id").alias("id")).agg(F.min("markers").alias("marker_typed"))
    return N.add_markers(dataset_tables(spark, d), table, ["typed"]).obs.select("obs_id", "marker_typed")


def sparse_labels(spark, d):
    """Majority labels without one label, as a caller asks who else is near."""
    ds = dataset_tables(spark, d)
    first = _labels(spark, d, ds).where("label IS NOT NULL").agg(F.min("label")).first()[0]
    return L.majority_label(_edges(spark, d), _labels(spark, d, ds), exclude=first)


def knn_f1_rows(spark, d):
    """True and predicted labels side by side, as the score reads them."""
    return _predicted(spark, d)


def movement_score(spark, d):
    """Movement between UNTAGGED and PROTEOME over the first three replicates, fractions by dataset."""
    ds = dataset_tables(spark, d)
    var = ds.var.where("covariate_bait IN ('UNTAGGED', 'PROTEOME') AND biological_replicate IS NOT NULL")
    three = [r[0] for r in var.select("biological_replicate").distinct().orderBy("biological_replicate").limit(3).collect()]
    return M.mr_score(ds.cells, var.where(F.col("biological_replicate").isin(*three)), "covariate_bait", "biological_replicate", "dataset")


def merge_clusters_by_terms(spark, d):
    ds = dataset_tables(spark, d)
    return C.merge_clusters_by_terms(L.symmetric_edges(ds.edges), _clusters(ds).where("cluster IS NOT NULL"), _genes(ds), _gene_sets(spark, d, ds))


QUERIES = {
    f.__name__: f
    for f in (
        knn_confusion_soft, true_class_probability, nearest_neighbours, relabel_edges, rbf_weights, pair_distances, score_histogram, ternary, feature_notes, imputed_counts, add_markers,
        sparse_labels, knn_f1_rows, movement_score, merge_clusters_by_terms,
    )
}

# The scores of one step of propagation, not rounded.
_PROP = X.ORACLE["propagate_labels"].rsplit("SELECT", 1)[0]
_NEAR = f"{_G}, t AS (SELECT src, dst FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 5), a AS (SELECT min(src) AS n FROM s)"

ORACLE = {
    "knn_confusion_soft": f"{_PROP}, r AS (SELECT label, category AS predicted, sum(value) AS n FROM l JOIN o USING (obs_id) WHERE label IS NOT NULL AND value > 0 GROUP BY 1, 2) SELECT label, predicted, round(n / sum(n) OVER (PARTITION BY label), 5) AS share FROM r",
    "true_class_probability": f"{_PROP} SELECT l.obs_id, label, round(coalesce(value, 0), 6) AS value FROM l LEFT JOIN o ON o.obs_id = l.obs_id AND o.category = l.label WHERE label IS NOT NULL",
    "competitive_propagation": f"{_PROP}, r AS (SELECT obs_id, category, value FROM o WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY value DESC, category) = 1)"
    " SELECT obs_id, CASE WHEN value >= 0.5 THEN category END AS label, round(value, 6) AS probability FROM r WHERE obs_id NOT IN (SELECT obs_id FROM l WHERE label IS NOT NULL) UNION ALL SELECT obs_id, label, 1.0 FROM l WHERE label IS NOT NULL",
    "connected_components": f"WITH RECURSIVE {_E}, k AS (SELECT u AS src, v AS dst FROM e WHERE w >= 0.5 UNION ALL SELECT v, u FROM e WHERE w >= 0.5), reach AS (SELECT src AS a, src AS b FROM k UNION SELECT r.a, k.dst FROM reach r JOIN k ON k.src = r.b) SELECT a AS node, min(b) AS component FROM reach GROUP BY 1",
    "nearest_neighbours": f"{_NEAR}, b AS (SELECT n AS obs_id FROM a UNION SELECT dst FROM t WHERE src = (SELECT n FROM a)) SELECT obs_id FROM b UNION SELECT dst FROM t WHERE src IN (SELECT obs_id FROM b)",
    "relabel_edges": f"{_G} SELECT a.gene_name_canonical AS src, b.gene_name_canonical AS dst, w FROM s JOIN p a ON a.obs_id = s.src JOIN p b ON b.obs_id = s.dst WHERE a.gene_name_canonical IS NOT NULL AND b.gene_name_canonical IS NOT NULL",
    "rbf_weights": f"{_G}, r AS (SELECT src, dst, 1 - w AS x FROM s), h AS (SELECT median(x) AS h FROM r WHERE x > 0) SELECT src, dst, round(exp(-x * x / (2 * h * h)), 8) AS w FROM r CROSS JOIN h",
    "pair_distances": "WITH q AS (SELECT DISTINCT obs_id, CAST(x_pca AS DOUBLE[]) AS x FROM protein_pca WHERE x_pca IS NOT NULL AND len(x_pca) = 48), f AS (SELECT * FROM q WHERE obs_id IN (SELECT DISTINCT obs_id FROM q ORDER BY 1 LIMIT 40))"
    " SELECT a.obs_id AS a, b.obs_id AS b, round(list_distance(a.x, b.x), 4) AS distance FROM f a CROSS JOIN f b",
    "score_histogram": f"WITH {_P}, e AS (SELECT CAST(min(n_peptides) AS DOUBLE) AS lo, (max(n_peptides) - min(n_peptides)) / 16.0 AS w FROM p), b AS (SELECT CAST(least(15, floor((n_peptides - lo) / w)) AS INTEGER) AS bin, lo, w FROM p CROSS JOIN e WHERE n_peptides IS NOT NULL)"
    " SELECT bin, round(min(lo + bin * w), 6) AS lo, count(*) AS n FROM b GROUP BY 1",
    "ternary": f"{_B}, f AS (SELECT var_id, row_number() OVER (ORDER BY var_pos, var_id) AS k FROM (SELECT * FROM v WHERE dataset IS NOT NULL ORDER BY dataset, var_pos, var_id LIMIT 3)),"
    " w AS (SELECT obs_id, sum(CASE WHEN k = 1 THEN x ELSE 0 END) AS a, sum(CASE WHEN k = 2 THEN x ELSE 0 END) AS b, sum(CASE WHEN k = 3 THEN x ELSE 0 END) AS c FROM m JOIN f USING (var_id) GROUP BY 1)"
    " SELECT obs_id, round(a / (a + b + c), 6) AS a, round(b / (a + b + c), 6) AS b, round(c / (a + b + c), 6) AS c FROM w WHERE a + b + c > 0",
    "feature_notes": f"WITH {_P} SELECT obs_id, CASE WHEN dataset = gene_name_canonical THEN dataset WHEN dataset IS NOT NULL AND gene_name_canonical IS NOT NULL THEN dataset || '; ' || gene_name_canonical END AS notes,"
    " CASE WHEN trim(potential_contaminant) <> '' THEN true END AS flag FROM p",
    "imputed_counts": f"{_B}, h AS (SELECT DISTINCT var_id FROM c), g AS (SELECT DISTINCT p.obs_id, v.var_id FROM p JOIN v USING (dataset) JOIN h ON h.var_id = v.var_id),"
    " n AS (SELECT g.obs_id, count(*) FILTER (WHERE m.x IS NULL) AS n_imputed FROM g LEFT JOIN m ON m.obs_id = g.obs_id AND m.var_id = g.var_id GROUP BY 1) SELECT obs_id, n_imputed FROM p LEFT JOIN n USING (obs_id)",
    "add_markers": f"WITH {_P}, t AS (SELECT obs_id, min(markers) AS marker_typed FROM proteins WHERE obs_id IS NOT NULL AND markers IS NOT NULL GROUP BY 1) SELECT obs_id, marker_typed FROM p LEFT JOIN t USING (obs_id)",
    "sparse_labels": f"{_G} SELECT src AS obs_id, label, count(*) AS n FROM s JOIN l ON l.obs_id = s.dst WHERE label IS NOT NULL AND label <> (SELECT min(label) FROM l) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) = 1",
    "knn_f1_rows": f"{_G}, g AS (SELECT src AS obs_id, label AS predicted FROM s JOIN l ON l.obs_id = s.dst WHERE label IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) = 1) SELECT obs_id, label, predicted FROM l LEFT JOIN g USING (obs_id)",
    "prune_markers": f"{_PROP}, r AS (SELECT obs_id, category, value FROM o WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY value DESC, category) = 1)"
    " SELECT l.obs_id, CASE WHEN category = label AND value >= 0.3 THEN label END AS label FROM l LEFT JOIN r USING (obs_id)",
    "rank_groups": f"{_B}, {_L}, j AS (SELECT label, var_id, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM m JOIN l USING (obs_id) WHERE label IS NOT NULL GROUP BY 1, 2),"
    " w AS (SELECT *, sum(n) OVER v - n AS n0, sum(s) OVER v - s AS s0, sum(q) OVER v - q AS q0 FROM j WINDOW v AS (PARTITION BY var_id)),"
    " z AS (SELECT *, (q - s * s / n) / (n - 1) / n + (q0 - s0 * s0 / n0) / (n0 - 1) / n0 AS e FROM w WHERE n > 1 AND n0 > 1) SELECT label, var_id, round((s / n - s0 / n0) / sqrt(e), 4) AS t FROM z WHERE e > 1e-12",
}
