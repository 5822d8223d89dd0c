"""Operators over the matrix on tables small enough to check by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilespark.bundle import SpatialDataset, diff_bundles
from profilespark.functions import stats as ST
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
from tests.conftest import rows


@pytest.fixture(scope="module")
def ds(spark):
    """Three proteins, two blocks of five samples, the second two higher."""
    x = [[1, 2, 5, 4, 3], [0, 1, 2, 3, 6], [1, 0, 1, 0, 2]]
    cells = [(f"p{i}", f"s{j}", float(v + (2 if j >= 5 else 0))) for i, r in enumerate(x) for j, v in enumerate(r + r)]
    sub = ["A", "A", "UNTAGGED", "B", "UNTAGGED"] * 2
    cov = ["x", "x", "x", "y", "y"] * 2
    var = [(f"s{j}", j, sub[j], cov[j], "1" if j < 5 else "2") for j in range(10)]
    obs = [("p0", 0, "g", "+", None), ("p1", 1, "g", None, "L"), ("p2", 2, None, "", "unknown")]
    return SpatialDataset(
        spark.createDataFrame(cells, "obs_id string, var_id string, x double"),
        spark.createDataFrame(obs, "obs_id string, obs_pos int, gene string, flag string, label string"),
        spark.createDataFrame(var, "var_id string, var_pos int, subcellular_enrichment string, covariate_1 string, biological_replicate string"),
        edges=spark.createDataFrame([("p0", "p1", 0.9), ("p1", "p0", 0.8), ("p1", "p1", 1.0), ("p1", "p2", None)], "src string, dst string, w double"),
    )


def test_filters(ds):
    assert rows(X.filter_proteins(ds, min_samples=10).obs, "obs_id") == [("p0",)]
    assert rows(X.filter_samples(ds, min_counts=7).var, "var_id") == [("s2",), ("s3",), ("s4",), ("s5",), ("s6",), ("s7",), ("s8",), ("s9",)]
    with pytest.raises(ValueError):
        X.filter_proteins(ds, min_samples=1, max_samples=2)
    with pytest.raises(ValueError):
        X.filter_proteins(ds, min_consecutive=2)
    assert rows(X.consecutive_runs(ds)) == [("p0", 10), ("p1", 9), ("p2", 6)]
    assert rows(X.filter_min_consecutive_fractions(ds, 5, "biological_replicate", 2).obs, "obs_id") == [("p0",)]
    with pytest.raises(ValueError):
        X.filter_min_consecutive_fractions(ds, 2, "biological_replicate")
    assert rows(X.filter_proteins_per_replicate(ds, ["biological_replicate"], 5, 2).obs, "obs_id") == [("p0",)]
    assert rows(X.remove_contaminants(ds, ["flag"], "+").obs, "obs_id") == [("p1",), ("p2",)]
    assert rows(X.unknown_to_null(ds.obs), "label") == [("L",), (None,), (None,)]
    assert "gene" not in X.drop_metadata(ds, "ge").obs.columns
    assert [d.obs.count() for d in X.align_datasets([ds, ds.keep_obs(ds.obs.limit(1))])] == [1, 1]


def test_longest_run(spark):
    df = spark.createDataFrame([([0.0, 1.0, 1.0, 0.0, 1.0],), ([1.0, 1.0, 1.0],), ([0.0, 0.0],), ([],), (None,)], "p array<double>")
    assert [r[0] for r in df.select(X.longest_run(F.col("p"))).collect()] == [2, 3, 0, 0, 0]


def test_remove_listed(spark, ds):
    lst = spark.createDataFrame([("p0",), (None,)], "id string")
    assert rows(X.remove_listed(ds, lst).obs, "obs_id") == [("p1",), ("p2",)]
    assert X.remove_listed(ds, lst.where("id = 'zz'")).obs.count() == 3


def test_aggregate(ds):
    a = A.aggregate_proteins(ds, ["gene"], "sum")
    assert rows(a.obs, "obs_id", "n_merged_proteins", "label") == [("g", 2, None)]
    assert {r.var_id: r.x for r in a.cells.collect()}["s4"] == 9.0
    b = A.aggregate_samples(ds, ["subcellular_enrichment"], "max")
    assert {(r.obs_id, r.var_id): r.x for r in b.cells.collect()}["p0", "UNTAGGED"] == 7.0
    t = A.normalize_total(ds, 1e6).cells.groupBy("var_id").agg(F.sum("x").alias("s"))
    assert all(abs(r.s - 1e6) < 1e-3 for r in t.collect())
    assert A.qc_obs(ds).where("obs_id = 'p1'").first().n_samples_by_intensity == 9
    assert {c: round(v, 4) for c, v in A.qc_var(ds, (1,)).where("var_id = 's0'").first().asDict().items() if c != "var_id"}["pct_intensity_in_top_1_proteins"] == 50.0
    cv = {r.obs_id: r.cv for r in A.replicate_cv(ds, ["covariate_1"]).where("covariate_1 = 'y'").collect()}
    assert cv["p2"] is None and abs(cv["p0"] - np.std([4, 3, 6, 5]) / 4.5) < 1e-12
    assert A.highly_variable_proteins(ds, 1).where("highly_variable").count() == 1


def test_enrichment(ds):
    e = A.enrichment_vs_untagged(ds, ["covariate_1"])
    assert {r.enrichment for r in e.select("enrichment").distinct().collect()} == {"A", "B"}
    r = e.where("obs_id = 'p0' AND enrichment = 'A'").first()
    assert r.lfc == np.median([1, 2, 3, 4]) - np.median([5, 7]) and r.df == 4
    a, b = np.array([1.0, 2, 3, 4]), np.array([5.0, 7])
    sp = ((a.var(ddof=1) * 3) + b.var(ddof=1)) / 4
    assert abs(r.t - (a.mean() - b.mean()) / math.sqrt(sp * (1 / 4 + 1 / 2))) < 1e-12
    with pytest.raises(ValueError):
        A.enrichment_vs_untagged(ds.with_(var=ds.var.where("subcellular_enrichment <> 'UNTAGGED'")), ["covariate_1"])
    with pytest.raises(ValueError):
        A.enrichment_vs_all(ds, ["nothing"])
    p = A.enrichment_vs_all(ds, ["covariate_1"], method="proportion")
    assert p.where("x < 0 OR x > 1").count() == 0


def test_tails():
    assert abs(ST.t_sf2(1, 1) - 0.5) < 1e-10 and abs(ST.t_sf2(math.sqrt(2), 2) - (1 - 1 / math.sqrt(2))) < 1e-10
    assert abs(ST.chi2_sf(3.0, 2) - math.exp(-1.5)) < 1e-12
    assert abs(ST.hypergeom_sf(4, 10, 4, 5) - 6 / 252) < 1e-12
    many = [(4, 10, 4, 5), (0, 10, 4, 5), (3, 5000, 100, 70), (9, 10, 4, 5), (1, 8, 8, 3)]
    assert np.allclose(ST.hypergeom_sf_many(*zip(*many)), [ST.hypergeom_sf(*x) for x in many])
    assert abs(ST.fisher_two_sided(3, 1, 1, 3) - 0.4857142857) < 1e-8
    assert abs(ST.log_gamma(np.array(5.0)) - math.log(24)) < 1e-10


def test_bh(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,), (None,)], "p double")
    q = {r.p: r.q for r in ST.bh_adjust(df, "p").collect()}
    assert [round(q[p], 9) for p in (0.01, 0.02, 0.03, 0.5)] == [0.04, 0.04, 0.04, 0.5] and q[None] is None


@pytest.fixture(scope="module")
def two_cliques(spark):
    pairs = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", 0.1)]
    edges = spark.createDataFrame(pairs, "src string, dst string, w double")
    labels = spark.createDataFrame([(f"{c}{i}", c.upper() if i < 3 else None) for c in "ab" for i in range(6)], "obs_id string, label string")
    return L.symmetric_edges(edges), labels


def test_graph(spark, ds, two_cliques):
    assert rows(G.undirected(ds.edges)) == [("p0", "p1", 0.9)]
    edges, labels = two_cliques
    u = edges.where("src < dst").withColumnsRenamed({"src": "u", "dst": "v"})
    cc = G.connected_components(u.where("w > 0.5"))
    assert cc.select("component").distinct().count() == 2 and cc.count() == 12
    assert G.shared_neighbours(u).where("n = 4").count() == 30
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "u string, v string")
    assert rows(G.connected_components(chain).select("component").distinct()) == [("n000",)]
    assert G.connected_components(chain.limit(0)).count() == 0


def test_propagation(two_cliques):
    edges, labels = two_cliques
    for kw in ({}, {"iterations": 5, "clamp": True}, {"method": "spreading", "iterations": 5}):
        p = L.propagate(edges, L.one_hot(labels), **kw)
        assert p.groupBy("obs_id").agg(F.sum("value").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
        got = L.best_category(p)
        assert got.where("upper(substr(obs_id, 1, 1)) <> label").count() == 0
    with pytest.raises(ValueError):
        L.propagate(edges, L.one_hot(labels), alpha=1.5)
    fixed = L.competitive_propagation(edges, labels, fix_markers=True)
    assert fixed.where("obs_id = 'a1' AND probability = 1").count() == 1 and fixed.count() == 12
    assert rows(L.majority_label(edges, labels).where("obs_id = 'b5'"), "label", "n") == [("B", 3)]
    assert L.interfacialness(edges, labels, least=1).where("second IS NOT NULL").count() == 2
    r = L.resolve_soft_labels(L.propagate(edges, L.one_hot(labels)))
    assert r.where("obs_id = 'a4'").first().status == "single"
    assert L.prune_markers(edges, labels).where("label IS NOT NULL").count() == 6
    assert L.nearest_neighbours(edges, "a0", 1, 3).count() == 4
    with pytest.raises(ValueError):
        L.nearest_neighbours(edges, "zz")


def test_f1_and_confusion(spark):
    t = spark.createDataFrame([("1", "A", "A"), ("2", "A", None), ("3", "B", "A"), ("4", None, "A"), ("5", "B", "B")], "obs_id string, label string, predicted string")
    f = {r.label: r.f1 for r in L.knn_f1(t).collect()}
    assert f["A"] == 2 / 4 and f["B"] == 2 / 3
    assert L.confusion(t).groupBy("label").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-12").count() == 0


def test_clusters(spark, two_cliques):
    edges, _ = two_cliques
    cl = spark.createDataFrame([(f"{c}{i}", c if not (c == "b" and i == 5) else "tiny") for c in "ab" for i in range(6)], "obs_id string, cluster string")
    merged = C.merge_small_clusters(edges, cl, 3)
    assert rows(merged.where("obs_id = 'b5'"), "cluster") == [("b",)]
    genes = cl.select("obs_id", F.col("obs_id").alias("gene"))
    sets = spark.createDataFrame([("SA", f"a{i}") for i in range(6)] + [("SB", f"b{i}") for i in range(6)], "term string, gene string")
    e = C.cluster_enrichment(cl, genes, sets)
    top = {r.cluster: r.term for r in C.top_terms(e).collect()}
    assert top["a"] == "SA" and top["b"] == "SB"
    d = C.paga_dendrogram(edges, cl)
    assert sorted(d["leaves"]) == ["a", "b", "tiny"] and C.cherry_pairs(d) == [("b", "tiny")]
    m = C.markov_clustering(edges.where("w > 0.5"), 2.0, rounds=8)
    assert m.select(F.substring("obs_id", 1, 1).alias("c"), "cluster").distinct().count() == 2
    seed = L.cluster_seed(cl, L.enrichment_distribution(e.select("cluster", "term", "p")))
    assert seed.groupBy("obs_id").agg(F.sum("value").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    go = C.merge_clusters_by_terms(edges, cl, genes, sets, connectivity_lower=0.1)
    assert go.select("cluster").distinct().count() == 2
    ev = C.merge_clusters_by_terms(edges, cl, genes, sets, connectivity_lower=0.1, method="evidence", max_active=2)
    assert ev.select("cluster").distinct().count() in (2, 3)


def test_metrics(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 1, (20, 3)), rng.normal(6, 1, (20, 3))))
    v = spark.createDataFrame([(f"i{k:02}", "AB"[k // 20], r.tolist()) for k, r in enumerate(x)], "obs_id string, label string, vec array<double>")
    s = {r.obs_id: r.silhouette for r in M.silhouette(v, block=7).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for k in (0, 25):
        own = (np.arange(40) // 20) == k // 20
        a, b = d[k][own].sum() / 19, d[k][~own].mean()
        assert abs(s[f"i{k:02}"] - (b - a) / max(a, b)) < 1e-6
    assert abs(M.qsep(v, 7).where("label = 'A' AND other = 'B'").first().distance - d[:20, 20:].mean()) < 1e-6
    assert M.calinski_harabasz(v).first().score > 50
    two = lambda a, b: spark.createDataFrame([("p", [float(a), float(b)])], "obs_id string, vec array<double>")
    assert M.remodeling(two(0, 0), two(3, 4)).first().score == 5.0
    assert np.argmax(M.robust_distances(np.vstack((rng.normal(0, 1, (60, 3)), [[20, 20, 20]])))) == 60


def test_mr_score(spark):
    rng = np.random.default_rng(1)
    cells, var = [], []
    for c, r, f in [(c, r, f) for c in ("ctrl", "treat") for r in "123" for f in range(5)]:
        var.append((f"{c}{r}{f}", c, r, f))
    base = rng.normal(10, 1, (100, 5))
    for i in range(100):
        for name, c, r, f in var:
            cells.append((f"p{i:03}", name, float(base[i, f] + rng.normal(0, 0.1) + (3 * (f + 1) if c == "treat" and i < 5 else 0))))
    cells, var = spark.createDataFrame(cells, "obs_id string, var_id string, x double"), spark.createDataFrame(var, "var_id string, c string, r string, f int")
    got = {x.obs_id: (x.m, x.r) for x in M.mr_score(cells, var, "c", "r", "f", iterations=3).collect()}
    assert len(got) == 100 and all(m >= 0 and abs(r) <= 1 + 1e-9 for m, r in got.values())
    assert min(got[f"p00{i}"][0] for i in range(5)) > 2 and got["p050"][0] < 2
    with pytest.raises(ValueError):
        M.mr_score(cells, var.where("c = 'ctrl'"), "c", "r", "f")


def test_space(spark, ds):
    g = V.impute_gaussian(ds)
    assert g.cells.count() == 30 and g.cells.where("x IS NULL").count() == 0 and rows(g.obs.where("n_imputed > 0"), "obs_id") == [("p1",), ("p2",)]
    assert rows(g.cells) == rows(V.impute_gaussian(ds.with_(cells=ds.cells.repartition(7))).cells)
    k = V.impute_knn(ds, 1, block=2)
    assert {(r.obs_id, r.var_id): r.x for r in k.cells.where("imputed").collect()}["p1", "s0"] == 1.0
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 4)) * [5, 1, 1, 1]
    v = spark.createDataFrame([(f"i{i:02}", r.tolist()) for i, r in enumerate(x)], "obs_id string, vec array<double>")
    near = {(r.src, r["rank"]): r.dst for r in V.exact_neighbours(v, 3, block=11).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert all(near[f"i{i:02}", 1] == f"i{np.argmin(d[i]):02}" for i in range(60))
    w = V.fuzzy_weights(V.exact_neighbours(v, 5))
    assert w.where("w <= 0 OR w > 1 + 1e-9").count() == 0
    back = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w2")).join(w, ["src", "dst"])
    assert back.count() == w.count() and back.where("abs(w - w2) > 1e-9").count() == 0
    pc = np.array([r.pcs for r in V.principal_components(v, 4, 2).orderBy("obs_id").collect()])
    assert abs(np.var(pc[:, 0], ddof=1) - np.linalg.eigvalsh(np.cov(x.T))[-1]) < 1e-8
    a, b = V.aligned_embedding([v, v], 4)
    assert M.remodeling(a, b).where("score > 1e-9").count() == 0


def test_annotation(spark, ds):
    m = spark.createDataFrame([("p0", "ER", None), ("p9", "PM", "X")], "id string, marker_one string, marker_two string")
    assert rows(N.add_markers(ds, m, ["one"]).obs, "obs_id", "marker_one") == [("p0", "ER"), ("p1", None), ("p2", None)]
    with pytest.raises(ValueError):
        N.add_markers(ds, m, ["nobody"])
    with pytest.raises(ValueError):
        N.add_markers(N.add_markers(ds, m), m)
    none = []
    terms = spark.createDataFrame([("T1", "root", none), ("T2", "mid", ["root"]), ("T3", "leaf", ["mid", "gone"]), ("T4", "loop", ["loop2"]), ("T5", "loop2", ["loop"])], "ac string, id string, hp array<string>")
    assert rows(N.find_roots(terms, starts=terms.where("ac = 'T3'"))) == [("T3", "T1")]
    assert N.find_roots(terms).where("ac IN ('T4', 'T5')").count() == 0
    j = '[{"commentType":"SUBCELLULAR LOCATION","subcellularLocations":[{"location":{"value":"Cell, inner","id":null}},{"location":{"value":"mid","id":null}}]},{"commentType":"SUBCELLULAR LOCATION","molecule":"x","subcellularLocations":[{"location":{"value":"no"}}]}]'
    e = spark.createDataFrame([("p", j)], "obs_id string, comments string")
    assert rows(N.parse_locations(e, terms), "pos", "coarse", "fine", "ac") == [(1, "Cell", "inner", None), (2, "mid", "mid", "T2")]
    f = spark.createDataFrame([('X /note="Helical; Name=1" /note="Helical; Name=2" /note="b"',), ("none",)], "c string")
    assert [r[0] for r in f.select(N.feature_notes(F.col("c"))).collect()] == ["Helical; b", None]
    names = spark.createDataFrame([("s10",), ("s9",), ("s1",)], "v string")
    assert [r.v for r in names.orderBy(N.natural_key(F.col("v"))).collect()] == ["s1", "s9", "s10"]
    c = rows(N.compartment_colours(spark.createDataFrame([("ER",), ("Cytosol",), ("Zork",)], "label string")))
    assert dict(c)["ER"] == N.COLOURS["er"] and dict(c)["Zork"] in N.FALLBACK


def test_models(spark):
    rng = np.random.default_rng(3)
    mu = np.array([[0, 0, 0], [5, 5, 0], [0, 5, 5]])
    data = [(f"i{k:03}", "ABC"[k % 3] if k < 60 else None, (mu[k % 3] + rng.normal(0, 1, 3)).tolist(), "ABC"[k % 3]) for k in range(240)]
    v = spark.createDataFrame([d[:3] for d in data], "obs_id string, label string, vec array<double>")
    truth = {d[0]: d[3] for d in data}
    m = S.fit_mixture(v, 3, 30)
    steps = np.diff(m.log_posterior)
    assert (steps > -1e-6 * np.abs(m.log_posterior[1:])).mean() >= 0.9
    got = S.predict_mixture(v, m).collect()
    assert np.mean([truth[r.obs_id] == r.label for r in got]) > 0.9 and all(0 <= r.outlier <= 1 for r in got)
    k = S.classify_kernel(v, 3, 1.0, 0.1, min_probability=0.0).collect()
    assert np.mean([truth[r.obs_id] == r.label for r in k]) > 0.9 and all(r.probability == 1 for r in k if int(r.obs_id[1:]) < 60)
    assert S.tune_kernel(v, 3, (1.0,), (0.01, 0.1), folds=3).count() == 2
    prof = v.select("obs_id", F.lit("c").alias("condition"), F.lit("1").alias("replicate"), "label", "vec")
    con = S.compartment_contributions(prof, epochs=60, rounds=1)
    assert con.groupBy("obs_id").agg(F.sum("value").alias("s")).where("abs(s - 1) > 1e-6").count() == 0


def test_set_activity():
    rng = np.random.default_rng(4)
    genes = [f"g{i}" for i in range(2000)]
    sets = {f"set{k}": set(rng.choice(genes, 40, replace=False)) for k in range(12)}
    on = sets["set3"] | sets["set7"]
    study = {g for g in genes if rng.random() < (0.8 if g in on else 0.05)}
    q, evidence, best = S.set_activity(study, sets, set(genes), max_active=3)
    assert q["set3"] > 0.9 and q["set7"] > 0.9 and max(v for k, v in q.items() if k not in ("set3", "set7")) < 0.5 and evidence > 0 and best == ["set3", "set7"]
    hand, _, _ = S.set_activity({"A", "B"}, {"s1": {"A", "B", "C"}, "s2": {"B", "C", "D"}}, set("ABCD"))
    assert hand["s1"] > hand["s2"]


def test_diffusion(spark, two_cliques):
    edges, labels = two_cliques
    seeds = labels.where("label IS NOT NULL").select("obs_id", F.col("label").alias("term"))
    out = S.independent_diffusion(edges, seeds, (0.3, 0.7), 5, 3)
    got = {r.obs_id: r.label for r in out["labels"].collect()}
    assert got["a5"] == "A" and got["b5"] == "B"
    one = S.independent_diffusion(edges, seeds, (0.5,), min_term_size=3)["scores"]
    names = sorted({r.src for r in edges.collect()})
    w, seeded = np.zeros((len(names), len(names))), {(r.obs_id, r.term) for r in seeds.collect()}
    for r in edges.collect():
        w[names.index(r.src), names.index(r.dst)] = r.w
    step = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    for term in "AB":
        y = np.array([float((n, term) in seeded) for n in names])
        h = np.linalg.solve(np.eye(len(names)) - 0.5 * step, 0.5 * y) - 0.5 * y
        want = np.minimum(1, h / h[y > 0].mean())
        for r in one.where(F.col("term") == term).collect():
            assert abs(r.value - want[names.index(r.obs_id)]) < 1e-3
    c = S.calibrate(out["scores"].withColumn("y", (F.upper(F.substring("obs_id", 1, 1)) == F.col("term")).cast("double")), folds=2)
    assert c.where("value < 0 OR value > 1").count() == 0
    nested = spark.createDataFrame([("p", "in", 0.9), ("p", "out", 0.95), ("q", "out", 0.9), ("q", "in", 0.1), ("r", "in", 0.1)], "obs_id string, term string, value double")
    lap = spark.createDataFrame([("in", "out", 1.0), ("out", "in", 0.2)], "a string, b string, c double")
    lab = {r.obs_id: (r.labels, r.smallest) for r in S.resolve_likelihood(nested, lap).collect()}
    assert lab == {"p": ("in", "in"), "q": ("out", "out"), "r": ("in", "in")}
    sets = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("b", "3"), ("b", "4")], "term string, gene string")
    assert {(r.a, r.b): r.c for r in S.containment(sets).collect()} == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 1.0, ("b", "a"): 0.5}


def test_plot_frames(spark, ds):
    e = A.enrichment_vs_untagged(ds, ["covariate_1"])
    assert P.volcano(e, 0.0, 2.0).where("hit").count() > 0
    with pytest.raises(ValueError):
        P.volcano(e.drop("pval"))
    assert P.pair_distances(ds.profiles().withColumnRenamed("profile", "vec"), ["p0", "p1"]).count() == 4
    with pytest.raises(ValueError):
        P.ternary(ds)
    three = ds.keep_var(ds.var.where("var_pos < 3"))
    assert all(abs(r.a + r.b + r.c - 1) < 1e-12 for r in P.ternary(three).collect())
    assert P.ellipse(np.zeros(3), np.diag([4.0, 1, 1]), np.eye(3)[:, :2])["width"] == 8.0
    assert sum(r.n for r in P.score_histogram(e, "lfc", 5).collect()) == e.where("lfc IS NOT NULL").count()


def test_bundle(spark, ds, tmp_path):
    ds.write_parquet(str(tmp_path / "b"))
    back = SpatialDataset.read_parquet(spark, str(tmp_path / "b"))
    assert rows(back.cells) == rows(ds.cells) and diff_bundles(ds, back) == []
    assert diff_bundles(ds, ds.with_(obs=ds.obs.drop("gene").withColumn("new", F.lit(1)))) == [("obs", "gene", "removed"), ("obs", "new", "added")]
    m = spark.createDataFrame([("p0", "A", 0.5), ("p0", "B", 0.5)], "obs_id string, category string, value double")
    assert ds.set_matrix("k", m).get_matrix("k").count() == 2
    with pytest.raises(ValueError):
        ds.set_matrix("k", m.unionByName(m))


def test_classifiers_take_all_labels_and_dimensions(spark, sf_dir, monkeypatch):
    from profilespark.plans import matrix as Q

    known = {(r.obs_id, r.label) for r in Q._labelled_vectors(spark, sf_dir).where("label IS NOT NULL").collect()}
    got = {(r.obs_id, r.label) for r in Q.kernel_classifier(spark, sf_dir).collect()}
    assert known <= got
    models = []
    fit = S.fit_mixture
    monkeypatch.setattr(S, "fit_mixture", lambda *a, **kw: models.append(fit(*a, **kw)) or models[-1])
    Q.mixture_model(spark, sf_dir)
    assert set(models[0].classes) == {label for _, label in known} and models[0].mu.shape[1] == Q.DIM


def test_queries_run_until_still(spark, sf_dir):
    import warnings

    from profilespark.plans import matrix as Q

    edges = L.symmetric_edges(spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(9)], "src string, dst string, w double"))
    seed = L.one_hot(spark.createDataFrame([("n0", "a"), ("n9", "b")], "obs_id string, label string"))
    with pytest.warns(UserWarning, match="not still"):
        L.propagate(edges, seed, method="spreading", iterations=5)
    with pytest.warns(UserWarning, match="not still"):
        C.markov_clustering(edges, 2.0, rounds=2)
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message=".*not still")
        Q.spread_labels(spark, sf_dir)
        Q.markov_clustering(spark, sf_dir)


def test_set_activity_takes_all_terms(spark, sf_dir, monkeypatch):
    from profilespark.plans import matrix as Q

    asked = []
    monkeypatch.setattr(S, "cluster_set_activity", lambda clusters, genes, sets, **kw: asked.append((sets, kw)))
    Q.set_activity(spark, sf_dir)
    want = Q._gene_sets(spark, sf_dir, Q.dataset_tables(spark, sf_dir))
    sets, kw = asked[0]
    assert sets.select("term").distinct().count() == want.select("term").distinct().count() > 12 and kw.get("max_active", 4) == 4


def test_set_activity_reads_all_genes_and_sets(spark):
    """More than two million rows of sets and 200,000 genes, where reading once ended."""
    n = 200_100
    genes = spark.range(n).select(F.col("id").cast("string").alias("gene"))
    sets = spark.range(n).select(F.col("id").cast("string").alias("gene"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t"), "id").where("id % 16 <> t").select(F.format_string("t%02d", "t").alias("term"), "gene")
    small = spark.range(300).select((F.col("id") * 600).cast("string").alias("gene"), F.lit("zz").alias("term")).select("term", "gene")
    obs = genes.select(F.col("gene").alias("obs_id"), "gene")
    clusters = small.select(F.col("gene").alias("obs_id"), F.lit("c").alias("cluster"))
    got = {r.term: r.q for r in S.cluster_set_activity(clusters, obs, sets.unionByName(small), max_active=1).collect()}
    want, _, _ = S.set_activity({str(i * 600) for i in range(300)}, {f"t{t:02}": {str(i) for i in range(n) if i % 16 != t} for t in range(12)} | {"zz": {str(i * 600) for i in range(300)}}, {str(i) for i in range(n)}, max_active=1)
    assert sets.count() > 2_000_001 and got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want) and got["zz"] > 0.9


def test_set_activity_counts_covers_once_for_all_clusters(spark, monkeypatch):
    """What configurations cover is counted on the driver, once; each cluster gets what it gets on its own."""
    rng = np.random.default_rng(6)
    genes = [f"g{i}" for i in range(600)]
    sets = {f"s{k:02}": set(rng.choice(genes, 60, replace=False).tolist()) for k in range(12)}
    member = {f"c{k:02}": rng.choice(sorted(sets[f"s{k % 12:02}"]), 15, replace=False).tolist() for k in range(20)}
    made, make = [], S.set_model
    monkeypatch.setattr(S, "set_model", lambda *a: made.append(make(*a)) or made[-1])
    obs = spark.createDataFrame([(c, f"{c}{g}", g) for c, own in member.items() for g in own] + [(None, g, g) for g in genes], "cluster string, obs_id string, gene string")
    pairs = spark.createDataFrame([(t, g) for t, own in sets.items() for g in own], "term string, gene string")
    got = {(r.cluster, r.term): r.q for r in S.cluster_set_activity(obs.select("obs_id", "cluster"), obs.select("obs_id", "gene"), pairs).collect()}
    assert len(made) == 1 and len(got) == 240
    for c, own in member.items():
        want, _, _ = S.set_activity(set(own), sets, set().union(*sets.values()))
        assert all(abs(got[c, t] - q) < 1e-9 for t, q in want.items())


def test_markov_clustering_takes_all_edges(spark, sf_dir):
    from profilespark.plans import matrix as Q

    edges = L.symmetric_edges(Q.dataset_tables(spark, sf_dir).edges)
    assert rows(Q.markov_clustering(spark, sf_dir), "obs_id") == rows(edges.select(F.col("src").alias("obs_id")).distinct())
    light = L.symmetric_edges(spark.createDataFrame([("a", "b", 0.2), ("b", "c", 0.2), ("a", "c", 0.2), ("d", "a", 0.0)], "src string, dst string, w double"))
    got = {r.obs_id: r.cluster for r in C.markov_clustering(light, 2.0).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"] == "d"


def test_distances_move_sums_not_rows_by_label(spark, monkeypatch):
    """Ids in twice, blocks without rows and labels of one row give what all pairs give; a row leaves a pair of blocks once."""
    rng = np.random.default_rng(7)
    data = [(f"i{k // 2 if k < 8 else k:03}", "AB"[k % 2] if k < 90 else "ABCD"[k % 3] if k < 99 else "D", rng.normal(k % 3, 1, 5)) for k in range(100)]
    v = spark.createDataFrame([(a, b, x.tolist()) for a, b, x in data], "obs_id string, label string, vec array<float>")
    x = np.array([d[2] for d in data], np.float32).astype(float)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    ids, labels = (np.array([d[k] for d in data]) for k in (0, 1))
    dist[ids[:, None] == ids[None]] = 0
    for block in (9, 1000):
        got = {(r.label, r.other): r.distance for r in M.qsep(v, block).collect()}
        assert len(got) == 16 and all(abs(got[a, b] - dist[labels == a][:, labels == b].mean()) < 1e-9 for a, b in got)
        sil = {(r.obs_id, r.label): r.silhouette for r in M.silhouette(v, block).collect()}
        assert len(sil) == len({(a, b) for a, b, _ in data}) and sil["i099", "D"] == 0
        for (i, a), s in sil.items():
            d = dist[(ids == i) & (labels == a)]
            n = {b: d.shape[0] * (labels == b).sum() for b in "ABCD"}
            own, far = d[:, labels == a].sum() / (n[a] - 1) if n[a] > 1 else 0, min(d[:, labels == b].sum() / n[b] for b in "ABCD" if b != a)
            assert abs(s - ((far - own) / max(own, far) if n[a] > 1 else 0)) < 1e-9
    seen = []
    apply = type(v.groupBy()).applyInArrow
    monkeypatch.setattr(type(v.groupBy()), "applyInArrow", lambda self, f, schema: seen.append(apply(self, f, schema)) or seen[-1])
    M.qsep(v, 50)
    assert seen[0].count() <= 3 * 2 * 16


def test_silhouette_moves_one_array_a_row_and_block(spark, monkeypatch):
    v = spark.createDataFrame([(f"i{k:03}", "ABCDE"[k % 5], [float(k), float(k * k % 17)]) for k in range(100)], "obs_id string, label string, vec array<double>")
    seen = []
    apply = type(v.groupBy()).applyInArrow
    monkeypatch.setattr(type(v.groupBy()), "applyInArrow", lambda self, f, schema: seen.append(apply(self, f, schema)) or seen[-1])
    assert M.silhouette(v, 50).count() == 100
    assert seen[0].count() == 200  # two blocks, not a row for each label besides


def test_silhouette_arrays_hold_a_label_once_not_once_a_block(spark, monkeypatch):
    v = spark.createDataFrame([(f"i{k:03}", "ABCDE"[k % 5], [float(k), float(k * k % 17)]) for k in range(100)], "obs_id string, label string, vec array<double>")
    seen = []
    apply = type(v.groupBy()).applyInArrow
    monkeypatch.setattr(type(v.groupBy()), "applyInArrow", lambda self, f, schema: seen.append(apply(self, f, schema)) or seen[-1])
    got = M.silhouette(v, 10).collect()  # ten blocks
    assert len(got) == 100 and seen[0].agg(F.sum(F.length("d"))).first()[0] <= 100 * 8 * (5 + 10 - 1)
    assert M._pairs_of_blocks(v, 10)[0].count() == 100 * 10


def test_silhouette_shuffles_only_vectors_with_a_label(spark, tmp_path, monkeypatch):
    """Few of many proteins have a label; an id comes twice, with one label, with two and with two vectors. As by SQL."""
    from profilespark.plans import matrix as Q
    from tests.compare import compare

    rng = np.random.default_rng(3)
    marks = [("p", "A"), ("p", "A"), ("q", "A"), ("q", "B"), *((f"r{k:02}", "ABCA"[k % 4]) for k in range(20)), ("s", "D"), ("t", "a"), ("none", "B"), *((f"u{k:03}", "?" if k % 2 else None) for k in range(400))]
    vectors = [(a, rng.normal(len(a), 1, Q.DIM).tolist()) for a in sorted({a for a, _ in marks} - {"none"})]
    vectors += [("q", rng.normal(0, 1, Q.DIM).tolist()), *vectors[:5], ("r01", None), ("alone", vectors[0][1])]
    made = {
        "proteins": spark.createDataFrame([(a, m, k) for k, (a, m) in enumerate(marks)] + [("p", "A", 0)], "obs_id string, markers string, obs_pos int"),
        "protein_pca": spark.createDataFrame(vectors, "obs_id string, x_pca array<float>"),
        "compartments": spark.createDataFrame([(x,) for x in "ABCD"], "compartment string"),
        "samples": spark.createDataFrame([], "var_id string"),
        "cells": spark.createDataFrame([], "obs_id string, var_id string, injection int, x double, loaded_at timestamp"),
        "connectivities": spark.createDataFrame([], "src string, dst string, w double"),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    copies, distinct = [], type(made["cells"]).distinct
    monkeypatch.setattr(type(made["cells"]), "distinct", lambda self: copies.append(self) or distinct(self))
    for most in (1000, 0):
        monkeypatch.setattr(Q, "MOST_LABELLED", most, raising=False)
        copies.clear()
        assert compare(spark, "silhouette", Q.silhouette, Q.ORACLE["silhouette"], str(tmp_path)) == ""
        assert max(df.count() for df in copies) < 40


def test_spreading_in_tasks_is_spreading_by_joins(spark, monkeypatch):
    """The same values from a graph that goes to the tasks and from one too large for it, by few jobs instead of one a step."""
    rng = np.random.default_rng(8)
    edges = L.symmetric_edges(spark.createDataFrame([(f"n{a:02}", f"n{b:02}", float(w)) for a, b, w in zip(rng.integers(30, size=80), rng.integers(30, size=80), rng.random(80).round(2))], "src string, dst string, w double"))
    labels = spark.createDataFrame([(f"n{k:02}", "abc"[k % 3] if k % 4 == 0 else None) for k in range(30)] + [("alone", "b")], "obs_id string, label string")
    writes, write = [], L.Scratch.write
    monkeypatch.setattr(L.Scratch, "write", lambda self, df: writes.append(1) or write(self, df))
    mine = {r.obs_id: (r.label, r.probability) for r in L.spread_labels(edges, labels).collect()}
    assert len(writes) <= 4
    slow = {r.obs_id: (r.label, r.probability) for r in L.best_category(L.propagate(edges, L.one_hot(labels), method="spreading", iterations=1000)).collect()}
    assert mine.keys() == slow.keys() and "alone" in mine and all(mine[k][0] == v[0] and abs(mine[k][1] - v[1]) < 1e-9 for k, v in slow.items())
    task = {(r.obs_id, r.category): r.value for r in L.propagate(edges, L.one_hot(labels), method="spreading", iterations=4, tol=1e-12).collect()}
    from profilespark.operators import graph

    monkeypatch.setattr(graph, "MOST_EDGES", 1)
    joined = {(r.obs_id, r.category): r.value for r in L.propagate(edges, L.one_hot(labels), method="spreading", iterations=4, tol=1e-12).collect()}
    assert joined.keys() == task.keys() and all(abs(v - task[k]) < 1e-9 for k, v in joined.items())


def test_diffusion_in_tasks_is_diffusion_by_joins(spark, monkeypatch):
    from profilespark.operators import graph

    rng = np.random.default_rng(9)
    edges = L.symmetric_edges(spark.createDataFrame([(f"n{a:02}", f"n{b:02}", float(w)) for a, b, w in zip(rng.integers(30, size=70), rng.integers(30, size=70), rng.random(70).round(2) + 0.01)], "src string, dst string, w double"))
    seeds = spark.createDataFrame([(f"n{k:02}", "abc"[k % 3]) for k in range(0, 30, 2)] + [("alone1", "b"), ("alone2", "b")], "obs_id string, term string")
    writes, write = [], S.Scratch.write
    monkeypatch.setattr(S.Scratch, "write", lambda self, df: writes.append(1) or write(self, df))
    mine = S.independent_diffusion(edges, seeds, (0.2, 0.5, 0.8), 3, 3, tol=1e-12)
    assert len(writes) <= 5
    got = {k: {tuple(r)[: 2 if k == "scores" else 1]: tuple(r) for r in v.collect()} for k, v in mine.items()}
    monkeypatch.setattr(graph, "MOST_EDGES", 1)
    for k, v in S.independent_diffusion(edges, seeds, (0.2, 0.5, 0.8), 3, 3, tol=1e-12).items():
        want = {tuple(r)[: 2 if k == "scores" else 1]: tuple(r) for r in v.collect()}
        assert want.keys() == got[k].keys()
        assert all(a == pytest.approx(b, abs=1e-9) if isinstance(a, float) else a == b for key, row in want.items() for a, b in zip(row, got[k][key])), k


def test_merging_tests_terms_only_of_what_changed(spark, monkeypatch):
    """Two pairs of cliques merge; the second round asks for the enrichment of the merged clusters only."""
    pairs = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abxy" for i in range(4) for j in range(i)] + [(f"{p}{i}", f"{q}{j}", 1.0) for p, q in ("ab", "xy") for i in range(4) for j in range(4)]
    edges = L.symmetric_edges(spark.createDataFrame([*pairs, ("z0", "z1", 1.0)], "src string, dst string, w double"))
    cl = spark.createDataFrame([(f"{c}{i}", c) for c in "abxy" for i in range(4)] + [("z0", "z"), ("z1", "z")], "obs_id string, cluster string")
    genes, sets = cl.select("obs_id", F.col("obs_id").alias("gene")), spark.createDataFrame([(t, f"{c}{i}") for t in ("ab", "xy") for c in t for i in range(4)], "term string, gene string")
    asked, enrich = [], C.cluster_enrichment
    monkeypatch.setattr(C, "cluster_enrichment", lambda now, *a: asked.append(now.select("cluster").distinct().count()) or enrich(now, *a))
    got = {r.obs_id: r.cluster for r in C.merge_clusters_by_terms(edges, cl, genes, sets).collect()}
    assert asked == [5, 2] and set(got.values()) == {"a", "x", "z"} and got["b3"] == "a" and got["y0"] == "x"


def test_linkage_stops_at_a_height():
    d = {("a", "b"): 0.2, ("c", "d"): 0.2, ("b", "c"): 0.5}
    assert C.average_linkage(list("abcd"), d) == [(0, 1, 0.2, 2), (2, 3, 0.2, 2), (4, 5, 0.875, 4)]
    assert C.average_linkage(list("abcd"), d, 0.5) == [(0, 1, 0.2, 2), (2, 3, 0.2, 2)]
