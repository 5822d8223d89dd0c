"""Records divided into clusters of mutually similar ones: community detection on a neighbour graph by modularity.

The graph is given as edges, or built from vectors by neighbour descent (``neighbours.build_graph``). Nodes move to the
neighbouring community with the largest gain in modularity, in rounds in which a part of the nodes may move; then each
community becomes one node, and so on level by level. Communities are described by their size and by the members with
the highest weighted degree inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilespark.llm.neighbours import build_graphs, neighbours_of_all
from profilespark.operators.graph import both_ways, connected_components, shared_neighbours, undirected
from profilespark.session import Scratch

#: A level, and the whole, end when modularity grows by less than this; a run that needs more rounds or levels fails.
STILL = 3e-4
MOST_MOVES, MOST_LEVELS = 100, 30


def vector_edges(vectors: DataFrame, id_col: str, vector_col: str, least: float, k: int = 10, trees: int = 12, leaf: int = 1200, reverse: int = 20, rounds: int = 12) -> DataFrame:
    """u < v, w: similarity of at least ``least``, and one among the k most similar of the other.

    Descent has more trees, larger leaves and more rounds than ``build_graph`` has without being told, as leaves get
    lost with the depth of the trees; it ends when few entries change.
    """
    graphs = build_graphs(vectors, id_col, vector_col, floor=least, trees=trees, leaf=leaf, reverse=reverse, rounds=rounds)
    pairs = neighbours_of_all(graphs, k, least).select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v"), F.col("sim").cast("double").alias("w"))
    return pairs.groupBy("u", "v").agg(F.max("w").alias("w"))


def _move(sym: DataFrame, state: DataFrame, total: float, number: int, resolution: float) -> DataFrame:
    """One round: node, k, comm, moved. sym: src, dst, w without loops; state: node, k, comm."""
    inside = sym.join(state.select(F.col("node").alias("dst"), "comm"), "dst").groupBy("src", "comm").agg(F.sum("w").alias("w_in"))
    tot = state.groupBy("comm").agg(F.sum("k").alias("tot"))
    own = state.select(F.col("node").alias("src"), "k", F.col("comm").alias("own"))
    options = inside.unionByName(own.select("src", F.col("own").alias("comm"), F.lit(0.0).alias("w_in")))
    options = options.groupBy("src", "comm").agg(F.sum("w_in").alias("w_in")).join(own, "src").join(tot, "comm")
    stays = F.col("comm") == F.col("own")
    gain = F.col("w_in") - resolution * F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / total
    options = options.withColumn("gain", F.round(gain, 9))
    best = options.groupBy("src", "k", "own").agg(F.max(F.struct("gain", F.when(stays, 1).otherwise(0).alias("stay"), F.xxhash64("comm").alias("h"), "comm")).alias("best"), F.max(F.when(stays, F.col("gain"))).alias("here"))
    may = F.pmod(F.xxhash64("src", F.lit(number)), F.lit(3)) > 0
    goes = may & (F.col("best.gain") > F.col("here") + 1e-9)
    return best.select(F.col("src").alias("node"), "k", F.when(goes, F.col("best.comm")).otherwise(F.col("own")).alias("comm"), goes.alias("moved"), "here")


def modularity_communities(edges: DataFrame, resolution: float = 1.0, still: float = STILL, scratch: Scratch | None = None) -> DataFrame:
    """node, community (the smallest node of it) of every node of the edges u, v, w (w > 0, each pair once).

    A level ends when no node moves or modularity grows by less than ``still`` in each of two rounds, and the whole ends
    with a level that brings less. A run that isn't still after MOST_MOVES rounds of a level or MOST_LEVELS levels raises. Ties go by a
    hash of the community, so results don't depend on the order of rows. No edges give no rows.
    """
    own = scratch or Scratch(edges.sparkSession, "communities")
    now = own.write(edges.where("w > 0 AND u <> v").select("u", "v", F.col("w").cast("double").alias("w")))
    sym = both_ways(now)
    found = own.write(sym.select(F.col("src").alias("node")).distinct().withColumn("at", F.col("node")))
    loops: DataFrame | None = None
    total = sym.agg(F.sum("w")).first()[0] or 0.0
    for level in range(MOST_LEVELS + 1 if total else 0):
        if level == MOST_LEVELS:
            raise RuntimeError(f"communities not still after {MOST_LEVELS} levels")
        degree = sym.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
        if loops is not None:
            degree = degree.unionByName(loops.select("node", F.col("w").alias("k"))).groupBy("node").agg(F.sum("k").alias("k"))
        state = own.write(degree.withColumn("comm", F.col("node")))
        first, values = None, []
        for m in range(MOST_MOVES + 1):
            if m == MOST_MOVES:
                raise RuntimeError(f"communities not still after {MOST_MOVES} rounds of level {level}")
            after = own.write(_move(sym, state.select("node", "k", "comm"), total, 1000 * level + m, resolution))
            # The sum of what each node has in its community differs from modularity by what a level doesn't change.
            said = after.agg(F.count_if("moved").alias("moved"), F.sum("here").alias("here")).first()
            values.append(said.here / total)
            first = values[0] if first is None else first
            own.release(state)
            state = after
            if not said.moved or len(values) > 2 and values[-1] - values[-3] < 2 * still:
                break
        if not said.moved and len(values) == 1:
            break
        labels = own.write(state.groupBy("comm").agg(F.min("node").alias("to")).join(state.select("node", "comm"), "comm").select("node", "to"))
        own.release(state)
        found_next = own.write(found.join(labels.withColumnRenamed("node", "at"), "at").select("node", F.col("to").alias("at")))
        flat = sym.join(labels.withColumnsRenamed({"node": "src", "to": "s"}), "src").join(labels.withColumnsRenamed({"node": "dst", "to": "d"}), "dst")
        flat = flat.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w"))
        if loops is not None:
            old = loops.join(labels, "node").select(F.col("to").alias("src"), F.col("to").alias("dst"), "w")
            flat = flat.unionByName(old).groupBy("src", "dst").agg(F.sum("w").alias("w"))
        flat_next = own.write(flat)
        own.release(found, now, labels)
        found, now = found_next, flat_next
        loops, sym = flat_next.where("src = dst").select(F.col("src").alias("node"), "w"), flat_next.where("src <> dst")
        if values[-1] - first < still or sym.isEmpty():
            break
    least = found.groupBy("at").agg(F.min("node").alias("community"))
    return found.join(least, "at").select("node", "community")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of the labels (node, community) over the edges u, v, w."""
    sym = both_ways(edges).join(labels.withColumnsRenamed({"node": "src", "community": "a"}), "src").join(labels.withColumnsRenamed({"node": "dst", "community": "b"}), "dst")
    by = sym.groupBy(F.col("a").alias("community")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    return by.agg(F.sum("k").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("k2")).select((F.col("inside") / F.col("m") - resolution * F.col("k2") / (F.col("m") * F.col("m"))).alias("modularity"))


def describe(edges: DataFrame, labels: DataFrame, typical: int = 3) -> DataFrame:
    """community, size, inside_weight, typical: the members with the highest weighted degree within, best first."""
    sym = both_ways(edges).join(labels.withColumnsRenamed({"node": "src", "community": "a"}), "src").join(labels.withColumnsRenamed({"node": "dst", "community": "b"}), "dst").where("a = b")
    degree = sym.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    each = labels.join(degree, "node", "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc(F.round("k", 9)), "node"))
    best = each.withColumn("r", rank).where(F.col("r") <= typical).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x.node).alias("typical"))
    sizes = each.groupBy("community").agg(F.count("*").alias("size"), F.round(F.sum("k") / 2, 6).alias("inside_weight"))
    return sizes.join(best, "community")


def strong_edges(proteins: DataFrame, connectivities: DataFrame, least: float = 0.5) -> DataFrame:
    """u < v, w of at least ``least``, both ends in proteins."""
    known = proteins.select("obs_id").where("obs_id IS NOT NULL").distinct()
    e = undirected(connectivities).where(F.col("w") >= least)
    return e.join(known.withColumnRenamed("obs_id", "u"), "u", "left_semi").join(known.withColumnRenamed("obs_id", "v"), "v", "left_semi").select("u", "v", "w")


def tied_clusters(proteins: DataFrame, connectivities: DataFrame, least_size: int = 4) -> DataFrame:
    """cluster_obs_id, obs_id: largest sets of proteins connected through ties, of ``least_size`` or more.

    Ties may join two communities and needn't join all of one, so modularity can't give these sets: they are the connected
    components of the ties. Nodes are numbered first, so that the rounds move numbers and not strings.
    """
    scratch = Scratch(proteins.sparkSession, "clusters")
    strong = scratch.write(strong_edges(proteins, connectivities))
    ids = scratch.write(strong.select(F.explode(F.array("u", "v")).alias("obs_id")).distinct().withColumn("n", F.monotonically_increasing_id()))
    numbered = strong.join(ids.withColumnsRenamed({"obs_id": "u", "n": "a"}), "u").join(ids.withColumnsRenamed({"obs_id": "v", "n": "b"}), "v")
    numbered = scratch.write(numbered.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    tied = scratch.write(shared_neighbours(numbered).where("n >= 2").select("u", "v"))
    parts = scratch.write(connected_components(tied, scratch))
    scratch.release(strong, numbered, tied)
    known = scratch.write(parts.join(ids.withColumnRenamed("n", "node"), "node").select("component", "obs_id"))
    by = known.groupBy("component").agg(F.count("*").alias("n"), F.min("obs_id").alias("cluster_obs_id")).where(F.col("n") >= least_size)
    return known.join(by, "component").select("cluster_obs_id", "obs_id")
