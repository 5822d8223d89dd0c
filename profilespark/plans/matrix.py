"""Queries over the annotated matrix, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilespark.bundle import SpatialDataset, dataset_tables, measured, present
from profilespark.operators import aggregate as A
from profilespark.operators import annotation as N
from profilespark.operators import clusters as C
from profilespark.operators import filters as X
from profilespark.operators import graph as G
from profilespark.operators import labels as L
from profilespark.operators import metrics as M
from profilespark.operators import models as S
from profilespark.operators import plotframes as P
from profilespark.operators import space as V
from profilespark.session import Scratch, broadcast_if_small, read_table

DIM = 48

#: Labelled proteins whose labels are broadcast to their vectors; each takes about 170 bytes.
MOST_LABELLED = 500_000


def _labels(spark: SparkSession, d: str, ds: SpatialDataset) -> DataFrame:
    """obs_id, label: the markers that are a compartment to the letter, else null."""
    names = F.broadcast(read_table(spark, d, "compartments").select(F.col("compartment").alias("label")))
    return ds.obs.select("obs_id", "markers").join(names, F.col("markers") == F.col("label"), "left").select("obs_id", "label")


def _exported_vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "protein_pca").where("x_pca IS NOT NULL").where(F.size("x_pca") == DIM).select("obs_id", F.col("x_pca").alias("vec"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _exported_vectors(spark, d).distinct()


def _labelled_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).join(_labels(spark, d, dataset_tables(spark, d)), "obs_id")


def _vectors_with_label(spark: SparkSession, d: str) -> DataFrame:
    """obs_id, vec, label: only of proteins with a label. Others go before copies are removed, so they aren't shuffled."""
    names = F.broadcast(read_table(spark, d, "compartments").select(F.col("compartment").alias("markers")))
    obs = read_table(spark, d, "proteins").where("obs_id IS NOT NULL").join(names, "markers", "left_semi").distinct()
    labels = Scratch(spark, "labels").write(obs.groupBy("obs_id").agg(F.collect_list("markers").alias("labels")))
    rows = _exported_vectors(spark, d).join(broadcast_if_small(labels, MOST_LABELLED), "obs_id").distinct()
    return rows.select("obs_id", "vec", F.explode("labels").alias("label"))


def _clusters(ds: SpatialDataset) -> DataFrame:
    return ds.obs.select("obs_id", F.col("mc_cluster").alias("cluster"))


def _gene_sets(spark: SparkSession, d: str, ds: SpatialDataset) -> DataFrame:
    """term, gene: the genes of the proteins typed into a compartment to the letter."""
    names = F.broadcast(read_table(spark, d, "compartments").select("compartment"))
    return ds.obs.join(names, F.col("cell_compartment") == F.col("compartment")).where("gene_name_canonical IS NOT NULL").select(F.col("compartment").alias("term"), F.col("gene_name_canonical").alias("gene")).distinct()


def _genes(ds: SpatialDataset) -> DataFrame:
    return ds.obs.select("obs_id", F.col("gene_name_canonical").alias("gene"))


def _sample_labels(ds: SpatialDataset) -> SpatialDataset:
    """Only datasets with untagged samples."""
    ok = ds.var.where("covariate_bait = 'UNTAGGED'").select("dataset").distinct()
    return ds.with_(var=ds.var.where("dataset IS NOT NULL AND covariate_bait IS NOT NULL").join(F.broadcast(ok), "dataset", "left_semi"))


def filter_samples(spark, d):
    return X.filter_samples(dataset_tables(spark, d), min_proteins=50).var.select("var_id")


def filter_samples_counts(spark, d):
    return X.filter_samples(dataset_tables(spark, d), max_counts=5000).var.select("var_id")


def filter_proteins(spark, d):
    return X.filter_proteins(dataset_tables(spark, d), min_samples=10).obs.select("obs_id")


def consecutive_runs(spark, d):
    return X.consecutive_runs(dataset_tables(spark, d), "dataset").where("dataset IS NOT NULL").select("obs_id", "dataset", F.col("run").cast("long").alias("run"))


def filter_consecutive_fractions(spark, d):
    return X.filter_min_consecutive_fractions(dataset_tables(spark, d), 8, "dataset", 1).obs.select("obs_id")


def filter_per_replicate(spark, d):
    return X.filter_proteins_per_replicate(dataset_tables(spark, d), ["dataset", "covariate_bait"], 3, 2).obs.select("obs_id")


def remove_contaminants(spark, d):
    return X.remove_contaminants(dataset_tables(spark, d), ["reverse_flag", "potential_contaminant"], "+").obs.select("obs_id")


def remove_listed(spark, d):
    """Contaminants named by a prefix in the packed id fields, as a list to remove by accession."""
    listed = read_table(spark, d, "mitocop").select(F.explode(F.regexp_extract_all("protein_ids", F.lit(r"CON__(\w+)"), F.lit(1))).alias("id"))
    return X.remove_listed(dataset_tables(spark, d), listed).obs.select("obs_id")


def unknown_to_null(spark, d):
    obs = X.unknown_to_null(dataset_tables(spark, d).obs.select("obs_id", "markers", "cell_compartment"))
    return obs


def drop_metadata(spark, d):
    return X.drop_metadata(dataset_tables(spark, d), "gene_|potential").obs.select("*")


def class_balance(spark, d):
    ds = dataset_tables(spark, d)
    ds = ds.with_(obs=ds.obs.drop("label").join(_labels(spark, d, ds), "obs_id"))
    return X.class_balance(ds, "label", 1).obs.groupBy("label").agg(F.count("*").alias("n"))


def validation_markers(spark, d):
    table = read_table(spark, d, "mitocop").distinct().select(F.col("record_id").cast("string").alias("id"), "gene_name", "mito_score", "mito_release")
    return N.add_validation_markers(dataset_tables(spark, d), table, ["mito_score", "mito_release"], use_genes=True, gene_column="gene_name_canonical").obs.select("obs_id", "mito_score", "mito_release")


def align_datasets(spark, d):
    ds = dataset_tables(spark, d)
    part = lambda p: ds.keep_obs(ds.cells.where(present()).join(ds.var.where(p).select("var_id"), "var_id", "left_semi"))
    return X.align_datasets([part("covariate_bait = 'UNTAGGED'"), part("covariate_bait = 'PROTEOME'")], intersect_var=False)[0].obs.select("obs_id")


def aggregate_proteins(spark, d):
    return A.aggregate_proteins(dataset_tables(spark, d), ["gene_name_canonical"]).cells.where("x IS NOT NULL").select("obs_id", "var_id", F.round("x", 6).alias("x"))


def aggregate_proteins_obs(spark, d):
    return A.aggregate_proteins(dataset_tables(spark, d), ["gene_name_canonical"]).obs.select("obs_id", "n_merged_proteins", "dataset", "mc_cluster")


def aggregate_samples(spark, d):
    return A.aggregate_samples(dataset_tables(spark, d), ["dataset", "covariate_bait"], "mean").cells.where("x IS NOT NULL").select("obs_id", "var_id", F.round("x", 6).alias("x"))


def qc_obs(spark, d):
    q = A.qc_obs(dataset_tables(spark, d))
    return q.select("obs_id", "n_samples_by_intensity", *[F.round(c, 6).alias(c) for c in q.columns[2:]])


def qc_var(spark, d):
    q = A.qc_var(dataset_tables(spark, d), (50, 100))
    return q.select("var_id", "n_proteins_by_intensity", *[F.round(c, 6).alias(c) for c in q.columns[2:]])


def replicate_cv(spark, d):
    return A.replicate_cv(dataset_tables(spark, d), ["dataset", "covariate_bait"], is_log=True).where("cv IS NOT NULL").select("obs_id", "dataset", "covariate_bait", F.round("cv", 6).alias("cv"))


def normalize_total(spark, d):
    return A.normalize_total(dataset_tables(spark, d)).cells.where(present()).select("obs_id", "var_id", F.round("x", 6).alias("x"))


def scale(spark, d):
    return A.scale(dataset_tables(spark, d)).cells.where("x IS NOT NULL").select("obs_id", "var_id", F.round("x", 6).alias("x"))


def minmax_rows(spark, d):
    return A.minmax_rows(dataset_tables(spark, d)).cells.where("x IS NOT NULL").select("obs_id", "var_id", F.round("x", 6).alias("x"))


def area_normalize(spark, d):
    return A.area_normalize(dataset_tables(spark, d), "biological_replicate").cells.where("x IS NOT NULL").select("obs_id", "var_id", F.round(F.col("x") + 1e-9, 6).alias("x"))


def highly_variable(spark, d):
    h = A.highly_variable_proteins(dataset_tables(spark, d), 100)
    return h.select("obs_id", F.round("mean", 6).alias("mean"), F.round("dispersion", 6).alias("dispersion"), F.round("dispersion_norm", 6).alias("dispersion_norm"))


def enrichment_vs_untagged(spark, d):
    e = A.enrichment_vs_untagged(_sample_labels(dataset_tables(spark, d)), ["dataset"], "covariate_bait", p_values=False)
    return e.select("obs_id", "condition", "enrichment", F.round("lfc", 6).alias("lfc"), F.round("t", 4).alias("t"), "df")


def enrichment_p_values(spark, d):
    return A.enrichment_vs_untagged(_sample_labels(dataset_tables(spark, d)), ["dataset"], "covariate_bait").select("obs_id", "condition", "enrichment", "lfc", "pval")


def enrichment_vs_all(spark, d):
    e = A.enrichment_vs_all(dataset_tables(spark, d), [], "covariate_bait", group="dataset")
    return e.select("obs_id", "condition", "enrichment", F.round("x", 6).alias("x"))


def enrichment_proportion(spark, d):
    e = A.enrichment_vs_all(dataset_tables(spark, d), [], "covariate_bait", method="proportion", group="dataset")
    return e.select("obs_id", "condition", "enrichment", F.round("x", 6).alias("x"))


def undirected_edges(spark, d):
    return G.undirected(dataset_tables(spark, d).edges)


def shared_neighbours(spark, d):
    return G.shared_neighbours(G.undirected(dataset_tables(spark, d).edges).where("w >= 0.5"))


def connected_components(spark, d):
    return G.connected_components(G.undirected(dataset_tables(spark, d).edges).where("w >= 0.5"))


def majority_label(spark, d):
    ds = dataset_tables(spark, d)
    return L.majority_label(L.symmetric_edges(ds.edges), _labels(spark, d, ds))


def interfacialness(spark, d):
    ds = dataset_tables(spark, d)
    return L.interfacialness(L.symmetric_edges(ds.edges), _labels(spark, d, ds), least=2).withColumn("score", F.round("score", 9))


def propagate_labels(spark, d):
    ds = dataset_tables(spark, d)
    return L.propagate(L.symmetric_edges(ds.edges), L.one_hot(_labels(spark, d, ds))).select("obs_id", "category", F.round("value", 6).alias("value"))


def competitive_propagation(spark, d):
    ds = dataset_tables(spark, d)
    return L.competitive_propagation(L.symmetric_edges(ds.edges), _labels(spark, d, ds), fix_markers=True, min_probability=0.5).withColumn("probability", F.round("probability", 6))


def spread_labels(spark, d):
    ds = dataset_tables(spark, d)
    return L.spread_labels(L.symmetric_edges(ds.edges), _labels(spark, d, ds), iterations=1000)


def resolve_labels(spark, d):
    ds = dataset_tables(spark, d)
    r = L.resolve_soft_labels(L.propagate(L.symmetric_edges(ds.edges), L.one_hot(_labels(spark, d, ds)), class_balance=False))
    return r.select("obs_id", "status", F.round("entropy", 6).alias("entropy"))


def prune_markers(spark, d):
    ds = dataset_tables(spark, d)
    return L.prune_markers(L.symmetric_edges(ds.edges), _labels(spark, d, ds), 0.3)


def _predicted(spark, d):
    ds = dataset_tables(spark, d)
    lab = _labels(spark, d, ds)
    got = L.majority_label(L.symmetric_edges(ds.edges), lab).select("obs_id", F.col("label").alias("predicted"))
    return lab.join(got, "obs_id", "left")


def knn_f1(spark, d):
    return L.knn_f1(_predicted(spark, d)).withColumn("f1", F.round("f1", 9))


def knn_confusion(spark, d):
    return L.confusion(_predicted(spark, d)).withColumn("share", F.round("share", 9))


def silhouette(spark, d):
    return M.silhouette(_vectors_with_label(spark, d)).select("obs_id", "label", F.round("silhouette", 5).alias("silhouette"))


def qsep(spark, d):
    return M.qsep(_labelled_vectors(spark, d)).select("label", "other", F.round("distance", 4).alias("distance"))


def calinski_harabasz(spark, d):
    return M.calinski_harabasz(_labelled_vectors(spark, d)).withColumn("score", F.round("score", 5))


def remodeling_score(spark, d):
    v = _vectors(spark, d)
    half = lambda a: v.select("obs_id", F.slice("vec", a, 24).alias("vec"))
    return M.remodeling(half(1), half(25)).withColumn("score", F.round("score", 4))


def label_transitions(spark, d):
    ds = dataset_tables(spark, d)
    return M.transitions(_labels(spark, d, ds), ds.obs.select("obs_id", F.col("mc_cluster").alias("label")))


def rank_groups(spark, d):
    ds = dataset_tables(spark, d)
    r = M.rank_groups(ds.cells, _labels(spark, d, ds))
    return r.select("label", "var_id", F.round("t", 4).alias("t"))


def mr_design(spark, d):
    """Differences of UNTAGGED and PROTEOME by replicate and dataset, as they go into the movement score."""
    ds = dataset_tables(spark, d)
    var = ds.var.where("covariate_bait IN ('UNTAGGED', 'PROTEOME')")
    return M.condition_differences(ds.cells, var, "covariate_bait", "biological_replicate", "dataset").select("obs_id", "replicate", F.round(F.col("profile")[0], 6).alias("d"))


def paga_connectivity(spark, d):
    ds = dataset_tables(spark, d)
    return C.paga_connectivity(L.symmetric_edges(ds.edges), _clusters(ds)).withColumn("connectivity", F.round("connectivity", 9))


def cluster_enrichment(spark, d):
    ds = dataset_tables(spark, d)
    e = C.cluster_enrichment(_clusters(ds), _genes(ds), _gene_sets(spark, d, ds))
    return e.select("cluster", "term", "overlap", "set_size", "cluster_size", "population", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


def cluster_distribution(spark, d):
    ds = dataset_tables(spark, d)
    e = C.cluster_enrichment(_clusters(ds), _genes(ds), _gene_sets(spark, d, ds)).select("cluster", "term", "p")
    return L.enrichment_distribution(e, 0.2).select("cluster", "category", F.round("value", 5).alias("value"))


def soft_cluster_annotation(spark, d):
    ds = dataset_tables(spark, d)
    e = C.cluster_enrichment(_clusters(ds), _genes(ds), _gene_sets(spark, d, ds)).select("cluster", "term", "p")
    return L.soft_cluster_annotation(L.symmetric_edges(ds.edges), _clusters(ds), e)


def merge_small_clusters(spark, d):
    ds = dataset_tables(spark, d)
    return C.merge_small_clusters(L.symmetric_edges(ds.edges), _clusters(ds).where("cluster IS NOT NULL"), 5)


def markov_clustering(spark, d):
    return C.markov_clustering(L.symmetric_edges(dataset_tables(spark, d).edges), 2.0, rounds=100)


def sample_correlation(spark, d):
    return V.sample_correlation(dataset_tables(spark, d)).select("a", "b", F.round("r", 6).alias("r"), "n")


def exact_neighbours(spark, d):
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("obs_id"), F.col("embedding").alias("vec"))
    return V.exact_neighbours(v, 5).select("src", "dst", F.round("dist", 4).alias("dist"), "rank")


def neighbour_graph(spark, d):
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("obs_id"), F.col("embedding").alias("vec"))
    return V.fuzzy_weights(V.exact_neighbours(v, 15))


def principal_components(spark, d):
    return V.principal_components(_vectors(spark, d), DIM, 2)


def impute_gaussian(spark, d):
    return V.impute_gaussian(dataset_tables(spark, d)).cells.select("obs_id", "var_id", "x", "imputed")


def mixture_model(spark, d):
    v = _labelled_vectors(spark, d)
    return S.predict_mixture(v, S.fit_mixture(v, DIM))


def kernel_classifier(spark, d):
    return S.classify_kernel(_labelled_vectors(spark, d), DIM, 1.0, 0.02)


def set_activity(spark, d):
    ds = dataset_tables(spark, d)
    return S.cluster_set_activity(_clusters(ds), _genes(ds), _gene_sets(spark, d, ds))


def independent_diffusion(spark, d):
    ds = dataset_tables(spark, d)
    seeds = _labels(spark, d, ds).where("label IS NOT NULL").select("obs_id", F.col("label").alias("term"))
    return S.independent_diffusion(L.symmetric_edges(ds.edges), seeds, min_term_size=3)["labels"]


def set_containment(spark, d):
    return S.containment(_gene_sets(spark, d, dataset_tables(spark, d))).withColumn("c", F.round("c", 9))


def ontology_roots(spark, d):
    """Suppliers under nations under regions as an ontology; the root of each supplier."""
    none = F.expr("CAST(array() AS array<string>)")
    r = read_table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("ac"), F.col("r_name").alias("id"), none.alias("hp"))
    n = read_table(spark, d, "nation").join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("N"), "n_nationkey").alias("ac"), F.col("n_name").alias("id"), F.array("r_name").alias("hp"))
    s = read_table(spark, d, "supplier").join(read_table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("ac"), F.col("s_name").alias("id"), F.array("n_name").alias("hp"))
    terms = r.unionByName(n).unionByName(s)
    return N.find_roots(terms, starts=terms.where("ac LIKE 'S%'"))


def compartment_colours(spark, d):
    return N.compartment_colours(read_table(spark, d, "compartments").select(F.col("compartment").alias("label")), cutoff=0.0)


def marker_profiles(spark, d):
    ds = dataset_tables(spark, d)
    p = P.marker_profiles(ds, _labels(spark, d, ds))
    return p.select("label", "var_id", *[F.round(c, 6).alias(c) for c in ("mean", "std", "sem")], "n")


def volcano(spark, d):
    e = A.enrichment_vs_untagged(_sample_labels(dataset_tables(spark, d)), ["dataset"], "covariate_bait")
    return P.volcano(e, 1.0, 0.05)


def embedding_frame(spark, d):
    v = _vectors(spark, d).select("obs_id", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))
    p = dataset_tables(spark, d).obs.select("obs_id", (F.col("n_peptides") / 100.0).alias("p"))
    return P.embedding_probability(v, p).select("obs_id", F.round("alpha", 6).alias("alpha"), "z_order")


def event_rollup(spark, d):
    """Counts and sums of events by hour and type, the batch form of the streaming roll-up."""
    from profilespark.streaming.rollup import rollup

    return rollup(read_table(spark, d, "events"))


QUERIES = {
    n: f
    for n, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", None) == __name__ and not n.startswith("_") and n not in ("measured", "present", "dataset_tables", "read_table")
}

_P = "p AS (SELECT DISTINCT * FROM proteins WHERE obs_id IS NOT NULL)"
_V = "v AS (SELECT DISTINCT * FROM samples WHERE var_id IS NOT NULL)"
_M = """c AS (SELECT obs_id, var_id, x FROM cells WHERE injection = 1
  QUALIFY row_number() OVER (PARTITION BY obs_id, var_id ORDER BY loaded_at DESC NULLS LAST, x DESC NULLS LAST) = 1),
m AS (SELECT * FROM c WHERE x IS NOT NULL AND NOT isnan(x) AND x <> 0)"""
_B = f"WITH RECURSIVE {_P}, {_V}, {_M}"
_E = """e AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(w) AS w FROM connectivities
  WHERE src <> dst AND w IS NOT NULL AND NOT isnan(w) GROUP BY 1, 2),
s AS (SELECT u AS src, v AS dst, w FROM e UNION ALL SELECT v, u, w FROM e)"""
_L = "l AS (SELECT obs_id, CASE WHEN markers IN (SELECT compartment FROM compartments) THEN markers END AS label FROM p)"
_G = f"WITH RECURSIVE {_P}, {_E}, {_L}"
_X = f"""WITH {_P}, {_L}, q AS (SELECT DISTINCT obs_id, x_pca FROM protein_pca WHERE x_pca IS NOT NULL),
x AS (SELECT obs_id, label, CAST(x_pca AS DOUBLE[]) AS vec FROM q JOIN l USING (obs_id) WHERE label IS NOT NULL)"""
_T = """g AS (SELECT DISTINCT cell_compartment AS term, gene_name_canonical AS gene FROM p WHERE gene_name_canonical IS NOT NULL AND cell_compartment IN (SELECT compartment FROM compartments))"""
_ORA = f"""WITH {_P}, {_T},
bg AS (SELECT DISTINCT gene_name_canonical AS gene FROM p WHERE gene_name_canonical IS NOT NULL),
cg AS (SELECT DISTINCT mc_cluster AS cluster, gene_name_canonical AS gene FROM p WHERE mc_cluster IS NOT NULL AND gene_name_canonical IS NOT NULL),
n AS (SELECT count(*) AS population FROM bg), ts AS (SELECT term, count(*) AS set_size FROM g GROUP BY 1), cs AS (SELECT cluster, count(*) AS cluster_size FROM cg GROUP BY 1),
h AS (SELECT cluster, term, count(*) AS overlap FROM cg JOIN g USING (gene) GROUP BY 1, 2),
r AS (SELECT * FROM h JOIN ts USING (term) JOIN cs USING (cluster) CROSS JOIN n),
pv AS (SELECT *, least(1, list_sum(list_transform(range(overlap, least(set_size, cluster_size) + 1), lambda i: CASE WHEN population - set_size >= cluster_size - i THEN
  exp(lgamma(set_size + 1) - lgamma(i + 1) - lgamma(set_size - i + 1) + lgamma(population - set_size + 1) - lgamma(cluster_size - i + 1) - lgamma(population - set_size - cluster_size + i + 1)
    - lgamma(population + 1) + lgamma(cluster_size + 1) + lgamma(population - cluster_size + 1)) ELSE 0 END))) AS p FROM r)"""
_COND = """d0 AS (SELECT DISTINCT dataset FROM v WHERE covariate_bait = 'UNTAGGED'),
w AS (SELECT var_id, dataset AS condition, covariate_bait AS enrichment FROM v WHERE dataset IN (SELECT dataset FROM d0) AND covariate_bait IS NOT NULL)"""

ORACLE = {
    "filter_samples": f"{_B} SELECT var_id FROM v JOIN m USING (var_id) GROUP BY 1 HAVING count(*) >= 50",
    "filter_samples_counts": f"{_B} SELECT v.var_id FROM v LEFT JOIN m USING (var_id) GROUP BY 1 HAVING coalesce(sum(x), 0) <= 5000",
    "filter_proteins": f"{_B} SELECT obs_id FROM p JOIN m USING (obs_id) GROUP BY 1 HAVING count(*) >= 10",
    "consecutive_runs": f"""{_B}, o AS (SELECT var_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY var_pos, var_id) AS place FROM v),
h AS (SELECT obs_id, dataset, place - row_number() OVER (PARTITION BY obs_id, dataset ORDER BY place) AS island FROM m JOIN o USING (var_id) WHERE dataset IS NOT NULL)
SELECT obs_id, dataset, max(n) AS run FROM (SELECT obs_id, dataset, island, count(*) AS n FROM h GROUP BY ALL) GROUP BY 1, 2""",
    "filter_consecutive_fractions": f"""{_B}, o AS (SELECT var_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY var_pos, var_id) AS place FROM v),
h AS (SELECT obs_id, dataset, place - row_number() OVER (PARTITION BY obs_id, dataset ORDER BY place) AS island FROM m JOIN o USING (var_id) WHERE dataset IS NOT NULL)
SELECT DISTINCT obs_id FROM (SELECT obs_id, dataset, island FROM h GROUP BY ALL HAVING count(*) >= 8) JOIN p USING (obs_id)""",
    "filter_per_replicate": f"""{_B}, k AS (SELECT obs_id, dataset, covariate_bait FROM m JOIN v USING (var_id) WHERE dataset IS NOT NULL AND covariate_bait IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT obs_id FROM k JOIN p USING (obs_id) GROUP BY 1 HAVING count(*) >= 2""",
    "remove_contaminants": f"WITH {_P} SELECT obs_id FROM p WHERE NOT (coalesce(reverse_flag = '+', FALSE) OR coalesce(potential_contaminant = '+', FALSE))",
    "remove_listed": f"WITH {_P}, k AS (SELECT DISTINCT unnest(regexp_extract_all(protein_ids, 'CON__(\\w+)', 1)) AS id FROM mitocop) SELECT obs_id FROM p WHERE split_part(obs_id, '-', 1) NOT IN (SELECT id FROM k)",
    "unknown_to_null": f"WITH {_P} SELECT obs_id, nullif(markers, 'unknown') AS markers, nullif(cell_compartment, 'unknown') AS cell_compartment FROM p",
    "drop_metadata": f"WITH {_P} SELECT * EXCLUDE (gene_names, gene_name_canonical, potential_contaminant) FROM p",
    "class_balance": f"WITH {_P}, {_L}, k AS (SELECT label, count(*) AS c FROM l WHERE label IS NOT NULL GROUP BY 1) SELECT label, (SELECT min(c) FROM k) AS n FROM k",
    "validation_markers": f"""WITH {_P}, t AS (SELECT DISTINCT * FROM mitocop), b AS (SELECT gene_name, mito_score, mito_release FROM t WHERE gene_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY (mito_score IS NULL)::INT + (mito_release IS NULL)::INT, record_id::VARCHAR) = 1)
SELECT p.obs_id, mito_score, mito_release FROM p LEFT JOIN b ON trim(p.gene_name_canonical) = b.gene_name""",
    "align_datasets": f"{_B} SELECT obs_id FROM p WHERE obs_id IN (SELECT obs_id FROM m JOIN v USING (var_id) WHERE covariate_bait = 'UNTAGGED') AND obs_id IN (SELECT obs_id FROM m JOIN v USING (var_id) WHERE covariate_bait = 'PROTEOME')",
    "aggregate_proteins": f"{_B} SELECT gene_name_canonical AS obs_id, var_id, round(median(x), 6) AS x FROM m JOIN p USING (obs_id) WHERE gene_name_canonical IS NOT NULL GROUP BY 1, 2",
    "aggregate_proteins_obs": f"""WITH {_P} SELECT gene_name_canonical AS obs_id, count(*) AS n_merged_proteins,
  CASE WHEN count(DISTINCT dataset) + max((dataset IS NULL)::INT) <= 1 THEN min(dataset) END AS dataset,
  CASE WHEN count(DISTINCT mc_cluster) + max((mc_cluster IS NULL)::INT) <= 1 THEN min(mc_cluster) END AS mc_cluster FROM p WHERE gene_name_canonical IS NOT NULL GROUP BY 1""",
    "aggregate_samples": f"{_B} SELECT obs_id, dataset || '_' || covariate_bait AS var_id, round(avg(x), 6) AS x FROM m JOIN v USING (var_id) WHERE dataset IS NOT NULL AND covariate_bait IS NOT NULL GROUP BY 1, 2",
    "qc_obs": f"""{_B}, n AS (SELECT count(*) AS n FROM v), t AS (SELECT p.obs_id, count(x) AS k, coalesce(sum(x), 0) AS t FROM p LEFT JOIN m USING (obs_id) GROUP BY 1)
SELECT obs_id, k AS n_samples_by_intensity, round(t, 6) AS total_intensity, round(t / n, 6) AS mean_intensity, round(ln(1 + t / n), 6) AS log1p_mean_intensity, round(ln(1 + t), 6) AS log1p_total_intensity,
  round(100 - 100.0 * k / n, 6) AS pct_dropout_by_intensity FROM t CROSS JOIN n""",
    "qc_var": f"""{_B}, n AS (SELECT count(*) AS n FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY var_id ORDER BY x DESC, obs_id) AS r FROM m),
t AS (SELECT v.var_id, count(x) AS k, coalesce(sum(x), 0) AS t, sum(x) FILTER (r <= 50) AS a, sum(x) FILTER (r <= 100) AS b FROM v LEFT JOIN r USING (var_id) GROUP BY 1)
SELECT var_id, k AS n_proteins_by_intensity, round(t, 6) AS total_intensity, round(100 - 100.0 * k / n, 6) AS pct_dropout_by_intensity,
  round(CASE WHEN t <> 0 THEN 100 * a / t END, 6) AS pct_intensity_in_top_50_proteins, round(CASE WHEN t <> 0 THEN 100 * b / t END, 6) AS pct_intensity_in_top_100_proteins FROM t CROSS JOIN n""",
    "replicate_cv": f"""{_B}, w AS (SELECT var_id, dataset, covariate_bait, count(*) OVER (PARTITION BY dataset, covariate_bait) AS size FROM v WHERE dataset IS NOT NULL AND covariate_bait IS NOT NULL)
SELECT obs_id, dataset, covariate_bait, round(sqrt(exp(var_pop(x)) - 1), 6) AS cv FROM m JOIN w USING (var_id) GROUP BY 1, 2, 3 HAVING count(*) = max(size)""",
    "normalize_total": f"{_B}, t AS (SELECT var_id, sum(x) AS t FROM m GROUP BY 1 HAVING sum(x) > 0), k AS (SELECT median(t) AS k FROM t) SELECT obs_id, var_id, round(x * k / t, 6) AS x FROM m JOIN t USING (var_id) CROSS JOIN k",
    "scale": f"{_B}, t AS (SELECT var_id, avg(x) AS a, stddev_samp(x) AS s FROM m GROUP BY 1) SELECT obs_id, var_id, round((x - a) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS x FROM m JOIN t USING (var_id)",
    "minmax_rows": f"{_B}, t AS (SELECT obs_id, min(x) AS a, max(x) AS b FROM m GROUP BY 1) SELECT obs_id, var_id, round((x - a) / CASE WHEN b > a THEN b - a ELSE 1 END, 6) AS x FROM m JOIN t USING (obs_id)",
    "area_normalize": f"{_B} SELECT obs_id, var_id, round(x / nullif(sum(x) OVER (PARTITION BY obs_id, biological_replicate), 0) + 1e-9, 6) AS x FROM m JOIN v USING (var_id)",
    "highly_variable": f"""{_B}, n AS (SELECT count(*) AS n FROM v), t AS (SELECT obs_id, sum(x) AS s, sum(x * x) AS q FROM m JOIN p USING (obs_id) GROUP BY 1),
u AS (SELECT obs_id, s / n AS mu, (q - n * (s / n) * (s / n)) / (n - 1) AS var FROM t CROSS JOIN n WHERE s > 0),
w AS (SELECT obs_id, ln(1 + mu) AS mean, CASE WHEN var > 0 THEN ln(var / mu) END AS dispersion FROM u),
b AS (SELECT *, least(19, floor((mean - min(mean) OVER ()) / CASE WHEN max(mean) OVER () > min(mean) OVER () THEN max(mean) OVER () - min(mean) OVER () ELSE 1 END * 20)) AS bin FROM w),
g AS (SELECT bin, avg(dispersion) AS a, stddev_samp(dispersion) AS d FROM b GROUP BY 1)
SELECT obs_id, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, round(CASE WHEN d > 0 THEN (dispersion - a) / d WHEN dispersion IS NOT NULL THEN 1 END, 6) AS dispersion_norm FROM b JOIN g USING (bin)""",
    "enrichment_vs_untagged": f"""{_B}, {_COND}, r AS (SELECT * FROM m JOIN w USING (var_id)),
a AS (SELECT obs_id, condition, enrichment, count(*) AS n, median(x) AS med, avg(x) AS m, coalesce(var_samp(x), 0) AS v FROM r WHERE enrichment <> 'UNTAGGED' GROUP BY 1, 2, 3),
b AS (SELECT obs_id, condition, count(*) AS n0, median(x) AS med0, avg(x) AS m0, coalesce(var_samp(x), 0) AS v0 FROM r WHERE enrichment = 'UNTAGGED' GROUP BY 1, 2),
j AS (SELECT *, n + n0 - 2 AS df, (v * (n - 1) + v0 * (n0 - 1)) / nullif(n + n0 - 2, 0) AS pooled FROM a JOIN b USING (obs_id, condition))
SELECT obs_id, condition, enrichment, round(med - med0, 6) AS lfc, round(CASE WHEN pooled > 0 THEN (m - m0) / sqrt(pooled * (1.0 / n + 1.0 / n0)) END, 4) AS t, df FROM j""",
    "enrichment_vs_all": f"""{_B}, t AS (SELECT dataset AS condition, obs_id, covariate_bait AS enrichment, median(x) AS x FROM m JOIN v USING (var_id) WHERE dataset IS NOT NULL AND covariate_bait IS NOT NULL GROUP BY 1, 2, 3)
SELECT a.obs_id, a.condition, a.enrichment, round(min(a.x) - median(b.x), 6) AS x FROM t a JOIN t b ON a.condition = b.condition AND a.obs_id = b.obs_id AND a.enrichment <> b.enrichment GROUP BY 1, 2, 3""",
    "enrichment_proportion": f"""{_B}, t AS (SELECT dataset AS condition, obs_id, covariate_bait AS enrichment, median(x) AS x FROM m JOIN v USING (var_id) WHERE dataset IS NOT NULL AND covariate_bait IS NOT NULL GROUP BY 1, 2, 3)
SELECT a.obs_id, a.condition, a.enrichment, round(min(a.x) / nullif(min(a.x) + sum(b.x), 0), 6) AS x FROM t a JOIN t b ON a.condition = b.condition AND a.obs_id = b.obs_id AND a.enrichment <> b.enrichment GROUP BY 1, 2, 3""",
    "undirected_edges": f"WITH {_E} SELECT u, v, w FROM e",
    "shared_neighbours": f"WITH {_E}, k AS (SELECT u, v FROM e WHERE w >= 0.5), b AS (SELECT u, v FROM k UNION ALL SELECT v, u FROM k) SELECT k.u, k.v, count(*) AS n FROM k JOIN b x ON x.u = k.u JOIN b y ON y.u = k.v AND y.v = x.v GROUP BY 1, 2",
    "majority_label": f"{_G} SELECT src AS obs_id, label, count(*) AS n FROM s JOIN l ON l.obs_id = s.dst WHERE label IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) = 1",
    "interfacialness": f"""{_G}, z AS (SELECT label, count(*) AS size FROM l WHERE label IS NOT NULL GROUP BY 1), c AS (SELECT src AS obs_id, label, count(*) AS n FROM s JOIN l ON l.obs_id = s.dst WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY n / size DESC, label) AS r FROM c JOIN z USING (label))
SELECT obs_id, max(label) FILTER (r = 1) AS first, max(label) FILTER (r = 2) AS second, round(coalesce(CASE WHEN count(*) = 2 THEN sum(n) / nullif(sum(size) - sum(n), 0) END, 0), 9) AS score FROM r WHERE r <= 2 GROUP BY 1""",
    "propagate_labels": f"""{_G}, y AS (SELECT src AS obs_id, label AS category, sum(w) AS value FROM s JOIN l ON l.obs_id = s.dst WHERE label IS NOT NULL GROUP BY 1, 2),
f AS (SELECT category, k / g AS f FROM (SELECT category, sum(value) AS g FROM y GROUP BY 1) JOIN (SELECT label AS category, count(*) AS k FROM l WHERE label IS NOT NULL GROUP BY 1) USING (category) WHERE g > 0),
b AS (SELECT obs_id, category, value * f AS value FROM y JOIN f USING (category)), o AS (SELECT obs_id, category, value / nullif(sum(value) OVER (PARTITION BY obs_id), 0) AS value FROM b)
SELECT obs_id, category, round(value, 6) AS value FROM o WHERE value > 0""",
    "resolve_labels": f"""{_G}, y AS (SELECT src AS obs_id, label, sum(w) AS v FROM s JOIN l ON l.obs_id = s.dst WHERE label IS NOT NULL GROUP BY 1, 2 HAVING sum(w) > 0),
o AS (SELECT obs_id, label, v / sum(v) OVER (PARTITION BY obs_id) AS p FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY p DESC, label) AS r, coalesce(sum(p) OVER (PARTITION BY obs_id ORDER BY p DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o),
h AS (SELECT obs_id, -sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12))) AS h, count(*) FILTER (r <= 3 AND b < 0.8 AND (r = 1 OR p >= 0.2)) AS k FROM r GROUP BY 1)
SELECT obs_id, CASE WHEN exp(h) > 3 THEN 'diffuse' WHEN exp(h) <= 1.5 OR k = 1 THEN 'single' ELSE 'multi' END AS status, round(h, 6) AS entropy FROM h""",
    "knn_f1": f"""{_G}, g AS (SELECT src AS obs_id, label AS predicted FROM s JOIN l ON l.obs_id = s.dst WHERE label IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) = 1),
t AS (SELECT label, predicted FROM l LEFT JOIN g USING (obs_id) WHERE label IS NOT NULL), a AS (SELECT label, count(*) FILTER (label IS NOT DISTINCT FROM predicted) AS tp, count(*) FILTER (label IS DISTINCT FROM predicted) AS fn FROM t GROUP BY 1),
b AS (SELECT predicted AS label, count(*) FILTER (label <> predicted) AS fp FROM t WHERE predicted IS NOT NULL GROUP BY 1)
SELECT label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + coalesce(fp, 0) + coalesce(fn, 0)) ELSE 0 END, 9) AS f1 FROM a FULL JOIN b USING (label)""",
    "knn_confusion": f"""{_G}, g AS (SELECT src AS obs_id, label AS predicted FROM s JOIN l ON l.obs_id = s.dst WHERE label IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) = 1)
SELECT label, predicted, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 9) AS share FROM l JOIN g USING (obs_id) WHERE label IS NOT NULL GROUP BY 1, 2""",
    "silhouette": f"""{_X}, d AS (SELECT a.obs_id, a.label, b.label AS other, sum(CASE WHEN a.obs_id = b.obs_id THEN 0 ELSE list_distance(a.vec, b.vec) END) AS d, count(*) AS n FROM x a CROSS JOIN x b GROUP BY 1, 2, 3),
k AS (SELECT obs_id, label, max(CASE WHEN label = other AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN label <> other THEN d / n END) AS b FROM d GROUP BY 1, 2)
SELECT obs_id, label, round(coalesce(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) END, 0), 5) AS silhouette FROM k""",
    "qsep": f"{_X} SELECT a.label, b.label AS other, round(sum(CASE WHEN a.obs_id = b.obs_id THEN 0 ELSE list_distance(a.vec, b.vec) END) / count(*), 4) AS distance FROM x a CROSS JOIN x b GROUP BY 1, 2",
    "calinski_harabasz": f"""{_X}, z AS (SELECT obs_id, label, unnest(vec) AS v, unnest(range(48)) AS j FROM x), y AS (SELECT label, j, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM z GROUP BY 1, 2),
t AS (SELECT j, sum(s) / sum(n) AS m FROM y GROUP BY 1), o AS (SELECT sum(n * (s / n - m) ** 2) AS b, sum(q - s * s / n) AS w FROM y JOIN t USING (j)), c AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM x)
SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS score, n, k FROM o CROSS JOIN c""",
    "remodeling_score": "SELECT obs_id, round(list_distance(CAST(x_pca[1:24] AS DOUBLE[]), CAST(x_pca[25:48] AS DOUBLE[])), 4) AS score FROM (SELECT DISTINCT obs_id, x_pca FROM protein_pca WHERE x_pca IS NOT NULL)",
    "label_transitions": f"WITH {_P}, {_L} SELECT label AS label_a, mc_cluster AS label_b, count(*) AS n FROM l JOIN p USING (obs_id) GROUP BY 1, 2",
    "mr_design": f"""{_B}, k AS (SELECT obs_id, biological_replicate AS replicate, dataset AS f, sum(CASE WHEN covariate_bait = 'PROTEOME' THEN x ELSE -x END) AS d, count(DISTINCT covariate_bait) AS n FROM m JOIN v USING (var_id) WHERE covariate_bait IN ('UNTAGGED', 'PROTEOME') GROUP BY 1, 2, 3)
SELECT obs_id, replicate, round(min_by(d, f), 6) AS d FROM k WHERE n = 2 GROUP BY 1, 2""",
    "paga_connectivity": f"""{_G}, k AS (SELECT obs_id, mc_cluster AS c FROM p WHERE mc_cluster IS NOT NULL), pr AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM s JOIN k a ON a.obs_id = s.src JOIN k b ON b.obs_id = s.dst GROUP BY 1, 2),
en AS (SELECT a AS c, sum(n) AS e FROM pr GROUP BY 1), sz AS (SELECT c, count(*) AS s FROM k GROUP BY 1), i AS (SELECT * FROM en JOIN sz USING (c)), t AS (SELECT count(*) AS t FROM k)
SELECT a, b, round(least(1, 2 * n / ((x.e * y.s + y.e * x.s) / (t - 1))), 9) AS connectivity FROM pr JOIN i x ON x.c = a JOIN i y ON y.c = b CROSS JOIN t WHERE a < b""",
    "cluster_enrichment": f"""{_ORA}, k AS (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY p) + count(*) OVER (PARTITION BY cluster, p) - 1 AS r, count(*) OVER (PARTITION BY cluster) AS t FROM pv),
q AS (SELECT *, least(1, min(p * t / r) OVER (PARTITION BY cluster ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q0 FROM k), q2 AS (SELECT *, min(q0) OVER (PARTITION BY cluster, p) AS q FROM q)
SELECT cluster, term, overlap, set_size, cluster_size, population, round((overlap + 0.5) * (population - set_size - cluster_size + overlap + 0.5) / ((cluster_size - overlap + 0.5) * (set_size - overlap + 0.5)), 6) AS odds_ratio, round(p, 8) AS p, round(q, 8) AS q FROM q2""",
    "cluster_distribution": f"""{_ORA}, s AS (SELECT cluster, term AS category, least(log10(0.2 / greatest(p, 1e-300)), 300) AS s FROM pv WHERE p < 0.2 UNION ALL SELECT DISTINCT cluster, 'unknown', 0 FROM pv)
SELECT cluster, category, round(exp(s) / sum(exp(s)) OVER (PARTITION BY cluster), 5) AS value FROM s""",
    "sample_correlation": f"""{_B}, k AS (SELECT dataset, obs_id, var_id, x FROM m JOIN v USING (var_id) WHERE dataset IS NOT NULL)
SELECT a.var_id AS a, b.var_id AS b, round(corr(a.x, b.x), 6) AS r, count(*) AS n FROM k a JOIN k b ON a.dataset = b.dataset AND a.obs_id = b.obs_id AND a.var_id <= b.var_id GROUP BY 1, 2""",
    "exact_neighbours": """WITH v AS (SELECT vec_id::VARCHAR AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT a.id AS src, b.id AS dst, round(list_distance(a.x, b.x), 4) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank FROM v a JOIN v b ON a.id <> b.id QUALIFY rank <= 5""",
    "set_containment": f"WITH {_P}, {_T}, n AS (SELECT term, count(*) AS n FROM g GROUP BY 1) SELECT a.term AS a, b.term AS b, round(count(*) / any_value(n), 9) AS c FROM g a JOIN g b USING (gene) JOIN n ON n.term = a.term GROUP BY 1, 2",
    "ontology_roots": "SELECT 'S' || s_suppkey AS ac, 'R' || n_regionkey AS root FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "marker_profiles": f"""{_B}, {_L} SELECT label, var_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(stddev_pop(x) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM m JOIN l USING (obs_id) WHERE label IS NOT NULL GROUP BY 1, 2""",
    "embedding_frame": f"""WITH {_P}, q AS (SELECT DISTINCT obs_id, x_pca FROM protein_pca WHERE x_pca IS NOT NULL), j AS (SELECT q.obs_id, n_peptides / 100.0 AS p FROM q LEFT JOIN p USING (obs_id)),
k AS (SELECT quantile_cont(p, 0.01) AS lo, quantile_cont(p, 0.99) AS hi FROM j)
SELECT obs_id, round(0.1 + 0.9 * least(greatest((coalesce(p, lo) - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 0), 1), 6) AS alpha, row_number() OVER (ORDER BY p NULLS FIRST, obs_id) AS z_order FROM j CROSS JOIN k""",
    "event_rollup": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
