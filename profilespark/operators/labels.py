"""Labels over a neighbour graph: votes, propagation, spreading, interfaces, soft assignments and their resolution.

Edge tables are src, dst, w in both directions (see ``symmetric_edges``); labels are obs_id, label with null for none.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilespark.functions.stats import bh_adjust, entropy
from profilespark.operators.graph import Walk, both_ways, by_category, numbered_walk, undirected
from profilespark.session import Scratch


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """src, dst, w: each pair once in both directions, with its largest weight; no loops, no null weights."""
    return both_ways(undirected(edges))


def first_max(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The row of each group with the largest value; of equal ones the first in the order given."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o") if dict(df.dtypes)[order] != "string" else F.lit(0).alias("o")))
    if dict(df.dtypes)[order] == "string":
        rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), order))
        return df.withColumn("_r", rank).where("_r = 1").drop("_r")
    return df.join(df.groupBy(by).agg(best.alias("_b")).select(by, F.col("_b.v").alias(value), (-F.col("_b.o")).alias(order)), [by, value, order])


def neighbour_counts(edges: DataFrame, labels: DataFrame, exclude: str | None = None) -> DataFrame:
    """obs_id, label, n, w: how many neighbours have each label, and their weights' sum."""
    lab = labels.where(F.col("label").isNotNull())
    if exclude is not None:
        lab = lab.where(F.col("label") != exclude)
    j = edges.join(lab.select(F.col("obs_id").alias("dst"), "label"), "dst")
    return j.groupBy(F.col("src").alias("obs_id"), "label").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def majority_label(edges: DataFrame, labels: DataFrame, exclude: str | None = None) -> DataFrame:
    """obs_id, label, n: the most frequent label among the neighbours; of equal ones the smallest."""
    return first_max(neighbour_counts(edges, labels, exclude), "obs_id", "n", "label").select("obs_id", "label", "n")


def interfacialness(edges: DataFrame, labels: DataFrame, exclude: str | None = None, least: int = 3) -> DataFrame:
    """obs_id, first, second, score: how much a protein lies between the two labels frequent around it.

    Counts under ``least`` are none; labels rank by count over label size; with d the counts and n the label sizes
    of the first two, the score is (d1 + d2) / (n1 + n2 - d1 - d2), and 0 where there is none.
    """
    sizes = labels.where(F.col("label").isNotNull() & (F.lit(True) if exclude is None else F.col("label") != exclude)).groupBy("label").agg(F.count("*").alias("size"))
    c = neighbour_counts(edges, labels, exclude).where(F.col("n") >= least).join(F.broadcast(sizes), "label")
    rank = F.row_number().over(Window.partitionBy("obs_id").orderBy(F.desc(F.col("n") / F.col("size")), "label"))
    top = c.withColumn("r", rank).where("r <= 2").groupBy("obs_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("label"))).alias("first"), F.max(F.when(F.col("r") == 2, F.col("label"))).alias("second"),
        F.sum("n").alias("d"), F.sum("size").alias("s"), F.count("*").alias("k"),
    )
    score = F.when(F.col("k") == 2, F.col("d") / F.when(F.col("s") != F.col("d"), F.col("s") - F.col("d")))
    return top.select("obs_id", "first", "second", F.coalesce(score, F.lit(0.0)).alias("score"))


def rbf_weights(edges: DataFrame, distance: str = "dist") -> DataFrame:
    """Distances to weights exp(-d^2 / 2 s^2), s the median of the distances that are not 0."""
    s = edges.where(F.col(distance) > 0).agg(F.median(distance).alias("_s"))
    return edges.join(F.broadcast(s)).withColumn("w", F.exp(-F.col(distance) * F.col(distance) / (2 * F.col("_s") * F.col("_s")))).drop("_s")


def _rows_to_one(df: DataFrame, value: str = "value") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy("obs_id"))
    return df.withColumn(value, F.when(total > 0, F.col(value) / total).otherwise(0.0))


def one_hot(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("label").isNotNull()).select("obs_id", F.col("label").alias("category"), F.lit(1.0).alias("value"))


def _spread(walk: Walk, at: np.ndarray, value: np.ndarray, alpha: float, iterations: int, tol: float) -> tuple[np.ndarray, float]:
    """One category's values after spreading, and what the last step changed."""
    seed = np.zeros(walk.n)
    seed[at] = value
    now, off = seed, 0.0
    for _ in range(iterations):
        new = alpha * walk.step(now) + (1 - alpha) * seed
        off = float(np.abs(new - now).sum())
        now = new
        if off < tol:
            break
    return now, off


def _warn_unless_still(off: float, tol: float, iterations: int) -> None:
    if off >= tol:
        warnings.warn(f"labels not still after {iterations} steps: the last changed {off:g}", stacklevel=3)


def spread_labels(edges: DataFrame, labels: DataFrame, alpha: float = 0.8, iterations: int = 1000, tol: float = 1e-3) -> DataFrame:
    """``best_category`` of ``propagate`` by spreading: obs_id, label, probability.

    Only the largest value and the sum of a task's categories leave it for a node, not a row for each category.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    scratch = Scratch(edges.sparkSession, "spread")
    seed = one_hot(labels)
    found = numbered_walk(edges, seed, scratch)
    if found is None:
        return best_category(propagate(edges, seed, method="spreading", alpha=alpha, iterations=iterations, tol=tol))
    nodes, walk = found
    seeds = by_category(seed, nodes, scratch)
    shared, most = edges.sparkSession.sparkContext.broadcast(walk), tol / max(1, seeds.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = shared.value
        rows = sorted((r for b in batches for r in zip(b["category"], b["at"], b["value"])), key=lambda r: r[0])
        total, best, which, change = np.zeros(walk.n), np.zeros(walk.n), np.zeros(walk.n, int), 0.0
        for k, (_, at, value) in enumerate(rows):
            y, off = _spread(walk, at, value, alpha, iterations, most)
            y *= value.sum() / y.sum() if y.sum() > 0 else 0.0  # classes are balanced
            change += off
            total += y
            better = y > best
            best[better], which[better] = y[better], k
        i = np.flatnonzero(best > 0)
        names = np.array([r[0] for r in rows], object)
        yield pd.DataFrame({"i": i.astype(np.int32), "label": names[which[i]] if len(i) else [], "value": best[i], "total": total[i]})
        yield pd.DataFrame({"i": np.array([-1], np.int32), "label": "", "value": change, "total": 0.0})

    each = scratch.write(seeds.mapInPandas(run, "i int, label string, value double, total double"))
    _warn_unless_still(each.where("i < 0").agg(F.sum("value")).first()[0] or 0.0, tol, iterations)
    top = each.where("i >= 0").groupBy("i").agg(F.sum("total").alias("total"), F.min(F.struct((-F.col("value")).alias("v"), "label")).alias("b"))
    return top.join(nodes, "i").select("obs_id", F.col("b.label").alias("label"), (-F.col("b.v") / F.col("total")).alias("probability"))


def _spread_all(edges: DataFrame, seed: DataFrame, alpha: float, iterations: int, tol: float, scratch: Scratch) -> DataFrame | None:
    """obs_id, category, value after spreading; None if the graph is too large for one task."""
    found = numbered_walk(edges, seed, scratch)
    if found is None:
        return None
    nodes, walk = found
    seeds = by_category(seed, nodes, scratch)
    shared, most = edges.sparkSession.sparkContext.broadcast(walk), tol / max(1, seeds.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for category, at, value in (r for b in batches for r in zip(b["category"], b["at"], b["value"])):
            y, off = _spread(shared.value, at, value, alpha, iterations, most)
            i = np.flatnonzero(y > 0)
            yield pd.DataFrame({"i": np.append(i, -1).astype(np.int32), "category": category, "value": np.append(y[i], off)})

    each = scratch.write(seeds.mapInPandas(run, "i int, category string, value double"))
    _warn_unless_still(each.where("i < 0").agg(F.sum("value")).first()[0] or 0.0, tol, iterations)
    return each.join(nodes, "i").select("obs_id", "category", "value")


def propagate(
    edges: DataFrame, seed: DataFrame, method: str = "propagation", alpha: float = 0.8, iterations: int = 1, class_balance: bool = True, clamp: bool = False, tol: float = 1e-3
) -> DataFrame:
    """obs_id, category, value: the seed (obs_id, category, value) carried along the edges, rows summing to one.

    propagation: Y = W S once, or again and again on rows scaled to one (clamp: seeds stay). spreading:
    Y <- a D^-1/2 W D^-1/2 Y + (1 - a) S. Class balance scales each category by its seed mass over what it got. Only
    categories that reach a row have one; a row that none reaches has no row here. Edges are joined on dst and summed
    by (src, category) each time: one row per edge and category, so the graph is read once per step, never squared.
    Spreading in many steps goes on category by category in tasks that hold the graph, where it isn't too large for one.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    scratch = Scratch(edges.sparkSession, "propagate")
    whole = _spread_all(edges, seed, alpha, iterations, tol, scratch) if method == "spreading" and iterations > 1 else None
    if method == "spreading" and whole is None:
        degree = edges.groupBy("src").agg(F.sum("w").alias("d")).where("d > 0")
        edges = edges.join(degree, "src").join(degree.withColumnsRenamed({"src": "dst", "d": "e"}), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))
    now = seed if whole is None else whole
    for step in range(iterations if whole is None else 0):
        y = edges.join(now.withColumnRenamed("obs_id", "dst"), "dst").groupBy(F.col("src").alias("obs_id"), "category").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
        if method == "spreading":
            y = y.select("obs_id", "category", (alpha * F.col("value")).alias("value")).unionByName(seed.select("obs_id", "category", ((1 - alpha) * F.col("value")).alias("value")))
            y = y.groupBy("obs_id", "category").agg(F.sum("value").alias("value"))
        elif iterations > 1:
            y = _rows_to_one(y)
            if clamp:
                y = y.join(seed.select("obs_id").distinct(), "obs_id", "left_anti").unionByName(seed.select("obs_id", "category", "value"))
        if iterations > 1:
            y = scratch.write(y)
            change = y.select("obs_id", "category", F.col("value").alias("a")).join(now.select("obs_id", "category", F.col("value").alias("b")), ["obs_id", "category"], "full")
            off = change.agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).first()[0] or 0.0
            if step:
                scratch.release(now)
            now = y
            if off < tol:
                break
            if step == iterations - 1:
                warnings.warn(f"labels not still after {iterations} steps: the last changed {off:g}", stacklevel=2)
        else:
            now = y
    if class_balance:
        mass = seed.groupBy("category").agg(F.sum("value").alias("s"))
        got = now.groupBy("category").agg(F.sum("value").alias("g"))
        factor = mass.join(got, "category").select("category", F.when(F.col("g") > 0, F.col("s") / F.col("g")).otherwise(0.0).alias("f"))
        now = now.join(F.broadcast(factor), "category").select("obs_id", "category", (F.col("value") * F.col("f")).alias("value"))
    return _rows_to_one(now).where("value > 0")


def best_category(scores: DataFrame, min_probability: float = 0.0) -> DataFrame:
    """obs_id, label, probability: the largest category of each row, null below the threshold; ties: the first name."""
    best = first_max(scores, "obs_id", "value", "category")
    return best.select("obs_id", F.when(F.col("value") >= min_probability, F.col("category")).alias("label"), F.col("value").alias("probability"))


def competitive_propagation(edges: DataFrame, labels: DataFrame, fix_markers: bool = False, min_probability: float = 0.0, **kw) -> DataFrame:
    """obs_id, label, probability by propagation of the known labels; fix_markers: they keep theirs, at 1."""
    out = best_category(propagate(edges, one_hot(labels), **kw), min_probability)
    if not fix_markers:
        return out
    known = labels.where(F.col("label").isNotNull()).select("obs_id", "label", F.lit(1.0).alias("probability"))
    return out.join(known.select("obs_id"), "obs_id", "left_anti").unionByName(known)


def prune_markers(edges: DataFrame, labels: DataFrame, min_probability: float = 0.9) -> DataFrame:
    """The labels that propagation from the neighbours confirms at the threshold; others become null."""
    got = best_category(propagate(edges, one_hot(labels)), min_probability).select("obs_id", F.col("label").alias("got"))
    return labels.join(got, "obs_id", "left").select("obs_id", F.when(F.col("label") == F.col("got"), F.col("label")).alias("label"))


def enrichment_distribution(results: DataFrame, threshold: float = 0.05, temperature: float = 1.0, s0: float = 0.0, s_max: float = 300.0, unknown: str = "unknown") -> DataFrame:
    """cluster, category, value from cluster, term, p: a softmax of log10(threshold / p) over terms that are below it.

    The unknown category has the logit s0. A cluster with no such term is all unknown.
    """
    s = F.least(F.greatest(F.log10(F.lit(threshold) / F.greatest("p", F.lit(1e-300))), F.lit(0.0)), F.lit(s_max))
    e = results.groupBy("cluster", F.col("term").alias("category")).agg(F.min("p").alias("p")).withColumn("s", s).where("s > 0").select("cluster", "category", "s")
    e = e.unionByName(results.select("cluster").distinct().select("cluster", F.lit(unknown).alias("category"), F.lit(s0).alias("s")))
    w = Window.partitionBy("cluster")
    z = F.exp((F.col("s") - F.max("s").over(w)) / temperature)
    return e.withColumn("z", z).select("cluster", "category", (F.col("z") / F.sum("z").over(w)).alias("value"))


def mgsa_distribution(posterior: DataFrame, inactivity: str = "product", unknown: str = "unknown") -> DataFrame:
    """cluster, category, value from cluster, term, q: posteriors with the chance that no set is active, to one."""
    real = posterior.select("cluster", F.col("term").alias("category"), F.col("q").alias("value")).where("value > 0")
    none = F.exp(F.sum(F.log(F.greatest(1 - F.col("q"), F.lit(1e-300))))) if inactivity == "product" else 1 - F.max("q")
    off = posterior.groupBy("cluster").agg(none.alias("value")).select("cluster", F.lit(unknown).alias("category"), "value")
    both = real.unionByName(off)
    return both.select("cluster", "category", (F.col("value") / F.sum("value").over(Window.partitionBy("cluster"))).alias("value"))


def cluster_seed(clusters: DataFrame, distribution: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Each protein starts with its cluster's distribution; one without a cluster is unknown."""
    some = clusters.where(F.col("cluster").isNotNull()).join(distribution, "cluster").select("obs_id", "category", "value")
    return some.unionByName(clusters.where(F.col("cluster").isNull()).select("obs_id", F.lit(unknown).alias("category"), F.lit(1.0).alias("value")))


def soft_cluster_annotation(edges: DataFrame, clusters: DataFrame, results: DataFrame, min_probability: float = 0.0, **kw) -> DataFrame:
    return best_category(propagate(edges, cluster_seed(clusters, enrichment_distribution(results)), **kw), min_probability)


def resolve_soft_labels(
    scores: DataFrame, unknown: str = "unknown", unknown_gate: float = 0.5, multi_label_cum: float = 0.8, single_eff_k: float = 1.5, eff_k_max: float = 3.0, max_labels: int = 3, min_secondary_mass: float = 0.2, null: DataFrame | None = None, alpha_fdr: float = 0.05
) -> DataFrame:
    """obs_id, status (unknown, diffuse, single, multi), labels, entropy, effective_k.

    Over the real categories scaled to one: entropy H and effective number exp(H). Above the gate a row is unknown;
    above eff_k_max, or not below its null (obs_id, p) after adjustment, diffuse; up to single_eff_k single; else the
    largest categories until their sum reaches multi_label_cum, at most max_labels, each of min_secondary_mass or more.
    """
    unk = scores.where(F.col("category") == unknown).select("obs_id", F.col("value").alias("u"))
    real = _rows_to_one(scores.where(F.col("category") != unknown)).where("value > 0")
    entry = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "category")))
    rows = scores.select("obs_id").distinct().join(real.groupBy("obs_id").agg(entry.alias("e")), "obs_id", "left").join(unk, "obs_id", "left").withColumn("u", F.coalesce("u", F.lit(0.0)))
    p = F.transform("e", lambda s: -s.v)
    rows = rows.withColumn("p", p).withColumn("c", F.transform("e", lambda s: s.category)).withColumn("entropy", entropy(F.col("p"))).withColumn("effective_k", F.exp("entropy"))
    if null is not None:
        rows = bh_adjust(rows.join(null.select("obs_id", F.col("p").alias("pn")), "obs_id", "left"), "pn", "qn")
        clear: Column = F.coalesce(F.col("qn") <= alpha_fdr, F.lit(False))
    else:
        clear = F.lit(True)
    before = F.transform("p", lambda x, i: F.aggregate(F.slice("p", 1, i), F.lit(0.0), lambda a, b: a + b))
    rows = rows.withColumn("before", before)
    take = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: (i <= max_labels) & (F.element_at("before", i) < multi_label_cum) & ((i == 1) | (F.element_at("p", i) >= min_secondary_mass)))
    status = F.when(F.col("e").isNull() | (F.col("u") >= unknown_gate), "unknown").when(~clear | (F.col("effective_k") > eff_k_max), "diffuse").when(F.col("effective_k") <= single_eff_k, "single").otherwise("multi")
    rows = rows.withColumn("status", status)
    multi = F.transform(take, lambda i: F.element_at("c", i))
    labels = F.when(F.col("status") == "single", F.slice("c", 1, 1)).when(F.col("status") == "multi", multi)
    return rows.select("obs_id", F.when((F.col("status") == "multi") & (F.size(labels) == 1), "single").otherwise(F.col("status")).alias("status"), F.array_join(labels, " / ").alias("labels"), "entropy", "effective_k")


def knn_f1(truth: DataFrame, weights: str = "macro") -> DataFrame:
    """label, tp, fp, fn, f1 from obs_id, label, predicted over rows with a label; a null prediction is a miss.

    The universe is the union of labels and predictions; a class that never occurs correctly has 0.
    """
    rows = truth.where(F.col("label").isNotNull())
    hit = F.col("label").eqNullSafe(F.col("predicted"))
    a = rows.groupBy("label").agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fn"))
    b = rows.where(F.col("predicted").isNotNull()).groupBy(F.col("predicted").alias("label")).agg(F.count_if(~hit).alias("fp"))
    j = a.join(b, "label", "full").fillna(0)
    return j.select("label", "tp", "fp", "fn", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("f1"))


def confusion(truth: DataFrame) -> DataFrame:
    """label, predicted, share: the crosstab with rows summing to one."""
    rows = truth.where(F.col("label").isNotNull() & F.col("predicted").isNotNull()).groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return rows.select("label", "predicted", (F.col("n") / F.sum("n").over(Window.partitionBy("label"))).alias("share"))


def soft_confusion(labels: DataFrame, scores: DataFrame) -> DataFrame:
    rows = labels.where(F.col("label").isNotNull()).join(scores, "obs_id").groupBy("label", F.col("category").alias("predicted")).agg(F.sum("value").alias("n"))
    return rows.select("label", "predicted", (F.col("n") / F.sum("n").over(Window.partitionBy("label"))).alias("share"))


def nearest_neighbours(edges: DataFrame, node: str, order: int = 1, n: int = 10) -> DataFrame:
    """Nodes reached from a node in ``order`` steps along the n heaviest edges of each, the node itself among them."""
    if not edges.where((F.col("src") == node) | (F.col("dst") == node)).limit(1).count():
        raise ValueError(f"no node {node}")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    top = edges.withColumn("r", rank).where(F.col("r") <= n).select("src", "dst")
    seen = edges.sparkSession.createDataFrame([(node,)], "obs_id string")
    for _ in range(order):
        seen = seen.unionByName(top.join(seen.withColumnRenamed("obs_id", "src"), "src").select(F.col("dst").alias("obs_id"))).distinct()
    return seen


def relabel_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The edges between the names (obs_id, name) of their ends."""
    a, b = names.select(F.col("obs_id").alias("src"), F.col("name").alias("a")), names.select(F.col("obs_id").alias("dst"), F.col("name").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
