"""Edge tables: cleaning, degrees, triangles and connected components, all by joins and aggregations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilespark.session import Scratch

#: Edges (each direction counts) of a graph that goes to every task whole; they take 12 bytes each there.
MOST_EDGES = 20_000_000


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst", w: str = "w") -> DataFrame:
    """u < v, w: one row per pair of different ends, whatever the direction, with the largest weight of its rows.

    Null ends and null or NaN weights don't count.
    """
    ok = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)) & F.col(w).isNotNull() & ~F.isnan(w))
    return ok.groupBy(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).agg(F.max(w).alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge u, v, w in both directions as src, dst, w."""
    out = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w")
    return out.unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), "w"))


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """u < v, n: for each edge that lies in a triangle the number of nodes joined to both ends.

    Edges are directed from the end of lower degree to that of higher; a node then has at most sqrt(2 edges) edges
    going out, however large a hub it is, so the pairs of them stay in proportion.
    """
    e = edges.select("u", "v")
    degree = e.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    e = e.join(degree.withColumnsRenamed({"node": "u", "d": "du"}), "u").join(degree.withColumnsRenamed({"node": "v", "d": "dv"}), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    out = e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("low"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("high"))
    a, b = out.withColumnRenamed("high", "a"), out.withColumnRenamed("high", "b")
    wedges = a.join(b, "low").where("a < b")
    triangles = wedges.join(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"])
    side = lambda x, y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    sides = triangles.select(F.explode(F.array(side("low", "a"), side("low", "b"), side("a", "b"))).alias("s"))
    return sides.groupBy("s.u", "s.v").agg(F.count("*").alias("n"))


def connected_components(edges: DataFrame, scratch: Scratch | None = None, most_rounds: int = 200) -> DataFrame:
    """node, component (the smallest node of it), by alternating large and small stars.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller ones; rounds grow as the
    logarithm of the size of a component, and a run that isn't still after ``most_rounds`` raises. The rows of a star's
    centre are many; they are reduced before the shuffle, and the join with the centre's one row is split where it is
    skewed (adaptive execution). edges: u, v; nodes without an edge are not in it.
    """
    spark = edges.sparkSession
    own = scratch or Scratch(spark, "components")
    e = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, last = own.write(e), None
    for _ in range(most_rounds):
        each = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = each.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = each.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = own.write(small)
        said = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        own.release(now)
        now = after
        if (said.n, said.h) == last:
            break
        last = (said.n, said.h)
    else:
        raise RuntimeError(f"components not still after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


@dataclass
class Walk:
    """D^-1/2 W D^-1/2 over n numbered nodes, by rows that have an entry: where they start, their columns and weights."""

    n: int
    rows: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray

    def step(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(self.weights * v[self.columns], self.starts)
        return out


def numbered_walk(edges: DataFrame, others: DataFrame, scratch: Scratch) -> tuple[DataFrame, Walk] | None:
    """nodes (obs_id, i: its place in order of ids) of the edges and of others (obs_id), and the walk over the edges.

    None if there are more than MOST_EDGES edges: they are counted before they go to the driver.
    """
    spark = edges.sparkSession
    edges = scratch.write(edges.select("src", "dst", F.col("w").cast("double").alias("w")))
    if edges.count() > MOST_EDGES:
        scratch.release(edges)
        return None
    ids = edges.select(F.col("src").alias("obs_id")).unionByName(edges.select(F.col("dst").alias("obs_id"))).unionByName(others.select("obs_id")).where("obs_id IS NOT NULL").distinct()
    placed = scratch.write(ids.orderBy("obs_id").withColumn("m", F.monotonically_increasing_id()))  # partition and place in it
    part = F.shiftright("m", 33)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    before = spark.createDataFrame([(r.p, sum(x.n for x in sizes[:k])) for k, r in enumerate(sizes)], "p long, before long")
    nodes = placed.join(F.broadcast(before), part == F.col("p")).select("obs_id", (F.col("before") + F.col("m") - F.shiftleft("p", 33)).cast("int").alias("i"))
    pairs = edges.join(nodes.withColumnsRenamed({"obs_id": "src", "i": "a"}), "src").join(nodes.withColumnsRenamed({"obs_id": "dst", "i": "b"}), "dst").select("a", "b", "w").toArrow()
    a, b, w = (pairs.column(c).to_numpy() for c in ("a", "b", "w"))
    n = sum(r.n for r in sizes)
    degree = np.bincount(a, weights=w, minlength=n)
    keep = (degree[a] > 0) & (degree[b] > 0)
    a, b, w = a[keep], b[keep], w[keep]
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    rows, starts = np.unique(a, return_index=True)
    scratch.release(edges)
    return nodes, Walk(n, rows, starts, b, w / np.sqrt(degree[a] * degree[b]))


def by_category(seed: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """category, at, value: places and values of each category's seed (obs_id, category, value), a row each, shared out evenly over the cores.

    A category is a small row and much work, which sizes of partitions don't tell.
    """
    rows = seed.join(nodes, "obs_id").groupBy("category", "i").agg(F.sum("value").alias("value")).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("e"))
    rows = scratch.write(rows.select("category", F.col("e.i").alias("at"), F.col("e.value").alias("value")).coalesce(1))
    return rows.repartition(max(1, min(rows.count(), seed.sparkSession.sparkContext.defaultParallelism)))
