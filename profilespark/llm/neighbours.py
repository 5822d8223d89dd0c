"""The most similar vectors of every vector: NN-descent by Spark joins, and greedy search in the graph it builds.

1. Vectors are scaled to length one. Vectors that are copies of another form a class with one representative.
2. A forest of random-projection trees, fitted on a bounded sample, puts every vector in one leaf per tree; the pairs
   within a leaf are the first neighbour lists.
3. Rounds of NN-descent: around each vector its neighbours, and those whose neighbour it is, are joined with their
   vectors; pairs of them that are better than what either has go into the lists. Only pairs with a member that is new
   to the list are looked at. Rounds end when few entries change.

A floor on the similarity keeps lists short for a caller who wants no others; each vector has some best entries below it
too, so all vectors take part in the descent. Vectors are compared with those of their own length only; each length of the
collection has a graph of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilespark.session import Scratch, broadcast_if_small

#: Vectors the trees are fitted on; the bound is for the driver's memory, all vectors are indexed.
SAMPLE = 20_000
LEAF, TREES, NEIGHBOURS, REVERSE, ROUNDS = 600, 3, 12, 12, 4
#: Entries a list has whatever the floor; lengths of vectors in one collection, each of which costs a graph of its own.
BELOW_FLOOR, MOST_LENGTHS = 1, 50
#: Leaf similarities come from vectors of 8-bit numbers; this much is allowed for below a floor until they are exact.
CODE_ERROR = 0.015
#: The same for a pair of the descent against the entry it must beat; a wider one makes more exact comparisons.
CODE_SLACK = 0.004


def _float_rows(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists in a row, and the length of each; a list that is null or has a null gets length 0."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten()
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(array), 0))
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32)
    return values, lengths


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, key, vec: vectors of length one as bytes of float32, and a hash that copies of a direction share.

    Left out: null ids and vectors, empty ones, ones with a null, NaN or infinite element, and all-zero ones. Of
    several rows with one id, the largest array counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, lengths = _float_rows(b.column(1))
            ends = np.cumsum(lengths)
            ids, dims, vecs, near = [], [], [], []
            for dim in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == dim)
                x = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
                with np.errstate(all="ignore"):
                    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
                    ok = np.isfinite(norm) & (norm > 0)
                    x = (x[ok] / norm[ok, None]).astype("<f4")
                ids.append(b.column(0).take(pa.array(rows[ok])))
                dims += [int(dim)] * len(x)
                vecs += [r.tobytes() for r in x]
                near += [r.tobytes() for r in np.round(x * 1e5).astype("<i4")]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(near, pa.binary())], ["id", "dim", "vec", "near"])

    one = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    one = one.groupBy("id").agg(F.max("v").alias("v"))
    return one.mapInArrow(run, "id string, dim int, vec binary, near binary").select("id", "dim", F.xxhash64("near", "dim").alias("key"), "vec")


class Forest:
    """Trees of hyperplanes between two vectors of the sample, cut at the median."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.depth = depth
        n, dim = sample.shape
        self.planes = np.zeros((trees, 2**depth - 1, dim), np.float32)
        self.cuts = np.zeros((trees, 2**depth - 1), np.float32)
        for t in range(trees):
            members = {0: np.arange(n)}
            for node in range(2**depth - 1):
                rows = members.pop(node)
                if len(rows) < 2:
                    plane = rng.normal(size=dim)
                    cut = 0.0
                else:
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    plane = a - b
                    if not np.any(plane):
                        plane = rng.normal(size=dim)
                    plane = plane / np.linalg.norm(plane)
                    cut = float(np.median(sample[rows] @ plane))
                self.planes[t, node], self.cuts[t, node] = plane, cut
                right = sample[rows] @ plane > cut
                members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", x, self.planes[tree, node]) > self.cuts[tree, node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def _matrix(column: pa.Array | pa.ChunkedArray, dtype: str, dim: int) -> np.ndarray:
    """Byte strings of one length as rows; no copy is made of each."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    width = np.dtype(dtype).itemsize * dim
    if not len(array):
        return np.zeros((0, dim), dtype)
    offsets = np.frombuffer(array.buffers()[1], np.int32)
    start = int(offsets[array.offset])
    return np.frombuffer(array.buffers()[2], dtype, count=len(array) * dim, offset=start).reshape(len(array), dim) if int(offsets[array.offset + len(array)]) - start == width * len(array) else np.stack([np.frombuffer(v, dtype) for v in array.to_pylist()])


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix of bytes as a byte string."""
    ends = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _codes(x: np.ndarray) -> np.ndarray:
    """8-bit numbers of each vector; their scale goes away as the vector has length one."""
    return np.round(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)


def _coded(dim: int):
    """Of rows (node, vec) the rows (node, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(_codes(_matrix(b.column(1), "<f4", dim)))], ["node", "code"])

    return run


def _top(s: np.ndarray, k: int, floor: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the k largest entries of each row that reach the floor, and of the ``least`` largest anyhow."""
    good = s >= floor
    n = good.sum(1)
    for rows, most in ((np.flatnonzero(n > k), k), (np.flatnonzero(n < least), least)):
        if len(rows) and most:
            part = np.argpartition(-s[rows], min(most, s.shape[1]) - 1, axis=1)[:, :most]
            keep = np.zeros((len(rows), s.shape[1]), bool)
            np.put_along_axis(keep, part, True, axis=1)
            good[rows] = keep
    good &= s > -1.5  # a vector is not its own neighbour
    i, j = np.nonzero(good)
    return i, j, s[i, j]


def _split(x: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows of a leaf that is larger than planned, split by further planes."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        p = x[rows] @ rng.normal(size=x.shape[1]).astype(np.float32)
        order = np.argsort(p, kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def first_lists(nodes: DataFrame, dim: int, k: int, floor: float, trees: int, leaf: int, sample_rows: int = SAMPLE) -> DataFrame:
    """u, v, sim of the pairs within leaves, the k best of each vector and tree; sim is near, not exact.

    The sample carries the trees to some depth. What they need more, for leaves of about ``leaf`` however many vectors
    there are, comes from random directions, each cut at its median within the leaf; medians are taken over all vectors.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    # A share of the rows by hash first, so that not every task sends the driver as many rows as the whole sample has.
    likely = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * 1.2 * sample_rows / max(1, n)))
    sample = nodes.select("node", "vec").where(likely).orderBy(F.xxhash64("node")).limit(sample_rows).collect()
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    by_trees = min(depth, max(0, int(math.log2(max(1, len(sample)))) - 3))
    more = depth - by_trees
    fitted = np.stack([np.frombuffer(r.vec, "<f4") for r in sample]) if sample else np.zeros((0, dim), np.float32)
    forest = spark.sparkContext.broadcast(Forest(fitted, by_trees, trees))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        directions = np.random.default_rng(11).normal(size=(trees, dim, more)).astype(np.float32)
        for b in batches:
            x = _matrix(b.column(1), "<f4", dim)
            data = _binary(_codes(x))
            for t in range(trees):
                bucket = (np.int64(t) << 40) + f.leaves(x, t)
                on = pa.FixedSizeListArray.from_arrays(pa.array((x @ directions[t]).ravel()), more).cast(pa.list_(pa.float32())) if more else pa.array([[]] * len(x), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0), data, on], ["bucket", "node", "code", "on"])

    def pairs(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        x = _matrix(table.column("code"), "i1", dim).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out = []
        for rows in _split(x, 4 * leaf, np.random.default_rng(len(ids))):
            s = x[rows] @ x[rows].T
            np.fill_diagonal(s, -2)
            i, j, v = _top(s, k, floor - CODE_ERROR, BELOW_FLOOR)
            out.append((ids[rows[i]], ids[rows[j]], v))
        u, v, s = (np.concatenate(c) for c in zip(*out))
        return pa.table({"u": u, "v": v, "sim": s.astype(np.float32)})

    placed = nodes.select("node", "vec").mapInArrow(place, "bucket long, node long, code binary, on array<float>")
    if more:
        # One row per leaf of the trees: at most trees * 2 ** by_trees, which the sample bounds.
        cuts = placed.groupBy("bucket").agg(F.array(*[F.percentile_approx(F.col("on")[i], 0.5, 200) for i in range(more)]).alias("cuts"))
        bits = sum((F.when(F.col("on")[i] > F.col("cuts")[i], 1 << i).otherwise(0) for i in range(more)), F.lit(0))
        placed = placed.join(F.broadcast(cuts), "bucket").select((F.shiftleft("bucket", more) + bits).alias("bucket"), "node", "code")
    return placed.select("bucket", "node", "code").groupBy("bucket").applyInArrow(pairs, "u long, v long, sim float")


def _best(edges: DataFrame, k: int, floor: float = -1.5) -> DataFrame:
    """The k best entries of each list that reach the floor, and a few anyhow, each once; fresh: no row of it has old = 1. Reduced before and after the shuffle."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    good = (F.col("rank") <= k) & ((F.col("sim") >= floor) | (F.col("rank") <= BELOW_FLOOR))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).where(good).select("u", "v", "sim", (F.col("old") == 0).alias("fresh"))


def exact_similarity(edges: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """The edges u < v once each, with their exact similarity."""
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    vec = nodes.select("node", "vec")
    both = pairs.join(vec.withColumnsRenamed({"node": "u", "vec": "x"}), "u").join(vec.withColumnsRenamed({"node": "v", "vec": "y"}), "v").select("u", "v", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _matrix(b.column(2), "<f4", dim), _matrix(b.column(3), "<f4", dim)
            s = np.einsum("ij,ij->i", x.astype(np.float64), y.astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.astype(np.float32))], ["u", "v", "sim"])

    return both.mapInArrow(run, "u long, v long, sim float")


def _weighed(pairs: DataFrame, nodes: DataFrame, dim: int, floor: float) -> DataFrame:
    """u, v, sim both ways: exact where it may reach the floor; below it, where entries only lead the descent on, by codes."""
    if floor <= -1:
        return _both_ways(exact_similarity(pairs, nodes, dim))
    may = F.col("sim") >= floor - CODE_ERROR
    below = pairs.where(~may).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim")
    return _both_ways(exact_similarity(pairs.where(may), nodes, dim).unionByName(below))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "sim").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))


def _around(lists: DataFrame, codes: DataFrame, k: int, floor: float, reverse: int) -> DataFrame:
    """Around each vector its list and up to ``reverse`` vectors that list it, with their codes and what a pair must beat.

    That is the worst entry of a full list; of another list the floor, or the worst of the few entries it has anyhow.
    """
    back = lists.select(F.col("v").alias("c"), F.col("u").alias("m"), "sim", "fresh")
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("fresh"), F.desc("sim"), "m"))
    back = back.withColumn("rank", rank).where(F.col("rank") <= reverse).drop("rank")
    members = lists.select(F.col("u").alias("c"), F.col("v").alias("m"), "sim", "fresh").unionByName(back)
    # Only around a vector that has something new and two others there is anything to compare; the others' codes aren't moved.
    around = Window.partitionBy("c")
    members = members.withColumn("any", F.max("fresh").over(around) & (F.min("m").over(around) < F.max("m").over(around)))
    members = members.where("any").groupBy("c", "m").agg(F.max("fresh").alias("fresh"))
    short = F.when(F.col("n") <= BELOW_FLOOR, F.least(F.when(F.col("n") < BELOW_FLOOR, F.lit(-2.0)).otherwise(F.col("low")), F.lit(floor))).otherwise(floor)
    worst = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("low")).select(F.col("u").alias("m"), F.when(F.col("n") >= k, F.col("low")).otherwise(short).cast("float").alias("worst"))
    members = members.join(codes.withColumnRenamed("node", "m"), "m").join(worst, "m", "left")
    entry = F.struct("m", "fresh", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"), "code")
    return members.groupBy("c").agg(F.collect_list(entry).alias("e")).select("e")


def descend(lists: DataFrame, codes: DataFrame, dim: int, k: int, floor: float, reverse: int) -> DataFrame:
    """u < v, sim by codes: pairs of neighbours of a vector that may be better than the worst entry of either list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(0)
            sizes = np.asarray(pa.compute.list_value_length(e))
            flat = e.flatten()
            ids, fresh = flat.field("m").to_numpy(zero_copy_only=False), flat.field("fresh").to_numpy(zero_copy_only=False)
            worst, x = flat.field("worst").to_numpy(zero_copy_only=False) - CODE_SLACK, _matrix(flat.field("code"), "i1", dim).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            at = np.cumsum(sizes) - sizes
            got = []
            for size in np.unique(sizes[sizes > 1]):
                rows = at[sizes == size][:, None] + np.arange(size)
                i, j = np.triu_indices(size, 1)
                for part in np.array_split(rows, max(1, len(rows) * int(size) // 20_000)):
                    xs = x[part]
                    s = np.matmul(xs, xs.transpose(0, 2, 1))[:, i, j]
                    a, c = part[:, i], part[:, j]
                    ok = (fresh[a] | fresh[c]) & ((s > worst[a]) | (s > worst[c])) & (ids[a] != ids[c])
                    p, q = ids[a[ok]], ids[c[ok]]
                    got.append((np.minimum(p, q), np.maximum(p, q), s[ok]))
            if got:
                p, q, s = (np.concatenate(c) for c in zip(*got))
                order = np.lexsort((q, p))
                p, q, s = p[order], q[order], s[order]
                once = np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])) if len(p) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(p[once]), pa.array(q[once]), pa.array(s[once].astype(np.float32))], ["u", "v", "sim"])

    return _around(lists, codes, k, floor, reverse).mapInArrow(run, "u long, v long, sim float")


class Graph:
    """Neighbour lists (u, v, sim, fresh) over nodes (node, id, vec), the classes of copies, and the members of each."""

    def __init__(self, lists: DataFrame, nodes: DataFrame, members: DataFrame, dim: int, k: int, scratch: Scratch, said: list[tuple[int, int]]):
        self.lists, self.nodes, self.members, self.dim, self.k, self.scratch = lists, nodes, members, dim, k, scratch
        self.said = said  # entries and new ones after each round of the descent


def build_graph(
    df: DataFrame, id_col: str, vector_col: str, k: int = NEIGHBOURS, floor: float = -1.5, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, reverse: int = REVERSE, still: float = 0.001
) -> Graph:
    """Neighbour lists of the k most similar vectors of each vector, of vectors that all have one length; else it raises.

    Rounds end after ``rounds``, or when fewer than ``still`` of all entries are new; ``Graph.said`` has their counts.
    """
    graphs = build_graphs(df, id_col, vector_col, k, floor, trees, leaf, rounds, reverse, still)
    if len(graphs) > 1:
        raise ValueError(f"vectors of {len(graphs)} lengths: {[g.dim for g in graphs]}; build_graphs makes one graph of each")
    return graphs[0]


def build_graphs(
    df: DataFrame, id_col: str, vector_col: str, k: int = NEIGHBOURS, floor: float = -1.5, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, reverse: int = REVERSE, still: float = 0.001
) -> list[Graph]:
    """One graph for each length of vector, that of most vectors first; one empty graph of an empty table."""
    scratch = Scratch(df.sparkSession, "neighbours")
    all_ = scratch.write(unit_vectors(df.select(id_col, vector_col), id_col, vector_col))
    dims = [int(r.dim) for r in all_.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS + 1).collect()] or [1]
    if len(dims) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    done = lambda dim: scratch.release(all_) if dim == dims[-1] else None
    return [_graph_of(all_.where(F.col("dim") == dim), dim, scratch, done, k, floor, trees, leaf, rounds, reverse, still) for dim in dims]


def _graph_of(all_: DataFrame, dim: int, scratch: Scratch, done: Callable[[int], None], k: int, floor: float, trees: int, leaf: int, rounds: int, reverse: int, still: float) -> Graph:
    copies = all_.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("key", "rep")
    copies = scratch.write(copies)
    known = all_.join(broadcast_if_small(copies), "key", "left").withColumn("rep", F.coalesce("rep", "id"))
    members = scratch.write(known.select("id", "rep"))
    nodes = scratch.write(known.where("id = rep").select(F.monotonically_increasing_id().alias("node"), "id", "vec"))
    codes = scratch.write(nodes.select("node", "vec").mapInArrow(_coded(dim), "node long, code binary"))
    done(dim)
    pairs = first_lists(nodes, dim, k, floor, trees, leaf)
    # Every vector has lists from every tree: the best by code go on, more than are kept.
    pairs = _best(pairs.withColumn("old", F.lit(0)), 2 * k if floor <= -1 else k + 2, floor - CODE_ERROR)
    pairs = scratch.write(pairs.select("u", "v", "sim"))
    lists = scratch.write(_best(_weighed(pairs, nodes, dim, floor).withColumn("old", F.lit(0)), k, floor))
    scratch.release(pairs)
    said = []
    for _ in range(rounds):
        found = scratch.write(descend(lists, codes, dim, k, floor, reverse))
        new = _weighed(found, nodes, dim, floor).withColumn("old", F.lit(0))
        better = scratch.write(_best(lists.select("u", "v", "sim", F.lit(1).alias("old")).unionByName(new), k, floor))
        scratch.release(lists, found)
        lists = better
        row = lists.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).first()
        said.append((row.n, row.fresh))
        if row.fresh <= still * row.n:
            break
    scratch.release(copies, codes)
    return Graph(lists, nodes, members, dim, k, scratch, said)


def neighbour_pairs(g: Graph, k: int, least: float = -1.5) -> DataFrame:
    """id, other, sim, rank: the k most similar of each vector, copies with it; of equal ones the smaller id comes first.

    A class of copies is not joined with itself: its members see the k + 1 members with the smallest ids, which is all
    that k places can hold.
    """
    head = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    heads = g.members.withColumn("h", head).where(F.col("h") <= k + 1).select(F.col("rep").alias("v_rep"), F.col("id").alias("other"))
    ends = g.lists.where(F.col("sim") >= least).select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ids = g.nodes.select("node", "id").join(broadcast_if_small(ends), "node", "left_semi")
    between = g.lists.where(F.col("sim") >= least).join(ids.withColumnsRenamed({"node": "u", "id": "u_rep"}), "u").join(ids.withColumnsRenamed({"node": "v", "id": "v_rep"}), "v").select("u_rep", "v_rep", "sim")
    many = g.members.where("id <> rep").select("rep").distinct()
    within = many.select(F.col("rep").alias("u_rep"), F.col("rep").alias("v_rep"), F.lit(1.0).cast("float").alias("sim"))
    pairs = between.unionByName(within).join(g.members.select("id", F.col("rep").alias("u_rep")), "u_rep").join(heads, "v_rep").where("id <> other")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))
    return pairs.select("id", "other", "sim", rank.alias("rank")).where(F.col("rank") <= k)


def neighbours_of_all(graphs: list[Graph], k: int, least: float = -1.5) -> DataFrame:
    """``neighbour_pairs`` of all graphs."""
    return reduce(DataFrame.unionByName, [neighbour_pairs(g, k, least) for g in graphs])


def similar_pairs(df: DataFrame, id_col: str, vector_col: str, least: float, k: int = 10, slack: float = 0.08, trees: int = TREES, rounds: int = ROUNDS) -> DataFrame:
    """obs_a < obs_b: similarity at least ``least``, and one among the k most similar of the other.

    Lists keep entries down to ``least - slack``, as neighbours of neighbours a little further off lead to near ones.
    """
    graphs = build_graphs(df, id_col, vector_col, k=k + 2, floor=least - slack, trees=trees, rounds=rounds)
    pairs = neighbours_of_all(graphs, k, least)
    return pairs.select(F.least("id", "other").alias("obs_a"), F.greatest("id", "other").alias("obs_b")).distinct()


def greedy_search(g: Graph, queries: DataFrame, k: int = 10, beam: int = 48, width: int = 12, entries: int = 1024, reverse: int = 40, most_hops: int = 200) -> DataFrame:
    """query, id, sim, rank: the k best vectors met on a greedy walk through the graph from each query.

    queries(id, vec) as of ``unit_vectors``, of the graph's length. A walk begins at the best of the same ``entries``
    vectors, a fixed few that go to every task; in each hop the ``width`` best vectors of the beam that were not yet
    left are left along their lists and up to ``reverse`` lists they are in, and the best ``beam`` of all stay, by their
    codes. A walk ends when all of its beam was left; then similarities are made exact. If one goes on after
    ``most_hops`` it raises. The query's own row is not an answer. Queries of an empty graph have no answers.
    """
    dim, codes, scratch = g.dim, g.nodes.select("node", "vec").mapInArrow(_coded(g.dim), "node long, code binary"), g.scratch
    codes = scratch.write(codes)
    back = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    back = g.lists.withColumn("r", back).where(F.col("r") <= reverse).select(F.col("v").alias("u"), F.col("u").alias("v"))
    links = scratch.write(g.lists.select("u", "v").unionByName(back).distinct())
    start = codes.orderBy(F.xxhash64("node")).limit(entries).collect()
    first_nodes = np.array([r.node for r in start], np.int64)
    first_codes = np.stack([np.frombuffer(r.code, "i1") for r in start]).astype(np.float32) if start else np.zeros((0, dim), np.float32)
    first_codes /= np.maximum(np.linalg.norm(first_codes, axis=1, keepdims=True), 1e-9)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _matrix(b.column(1), "<f4", dim) @ first_codes.T
            m = min(beam, near.shape[1])
            best = np.argpartition(-near, m - 1, axis=1)[:, :m] if m else np.zeros((len(near), 0), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(near)), m))), pa.array(first_nodes[best].ravel()), pa.array(np.take_along_axis(near, best, 1).ravel().astype(np.float32))], ["query", "node", "sim"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _matrix(b.column(2), "<f4", dim), _matrix(b.column(3), "i1", dim).astype(np.float32)
            s = np.einsum("ij,ij->i", x, y) / np.linalg.norm(y, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.astype(np.float32))], ["query", "node", "sim"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", _matrix(b.column(2), "<f4", dim).astype(np.float64), _matrix(b.column(3), "<f4", dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.astype(np.float32))], ["query", "node", "sim"])

    def met(pairs: DataFrame, table: DataFrame, column: str, run) -> DataFrame:
        return pairs.join(q, "query").join(table, "node").select("query", "node", "x", column).mapInArrow(run, "query string, node long, sim float")

    q = scratch.write(queries.select(F.col("id").alias("query"), F.col("vec").alias("x")))
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    now = scratch.write(q.mapInArrow(begin, "query string, node long, sim float").withColumn("open", F.lit(True)))
    for hop in range(most_hops + 1):
        turn = Window.partitionBy("query").orderBy(F.desc("open"), F.desc("sim"), "node")
        state = now.withColumn("leaves", F.col("open") & (F.row_number().over(turn) <= width))
        if now.where("open").isEmpty():
            break
        if hop == most_hops:
            raise RuntimeError(f"walks go on after {most_hops} hops")
        ahead = state.where("leaves").join(links, F.col("node") == F.col("u")).select("query", F.col("v").alias("node")).distinct()
        ahead = ahead.join(now.select("query", "node"), ["query", "node"], "left_anti")
        both = state.select("query", "node", "sim", (F.col("open") & ~F.col("leaves")).alias("open")).unionByName(met(ahead, codes, "code", score).withColumn("open", F.lit(True)))
        after = scratch.write(both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"))
        scratch.release(now)
        now = after
    sure = met(now.select("query", "node"), g.nodes.select("node", "vec"), "vec", exact)
    sure = scratch.write(sure.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"))
    scratch.release(now, links, codes)
    # A member of a class of copies sees its k + 1 smallest ids, which is all that k places can hold.
    head = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    heads = g.members.withColumn("h", head).where(F.col("h") <= k + 1).drop("h")
    found = sure.join(g.nodes.select("node", "id"), "node").withColumnRenamed("id", "rep").join(heads, "rep").where("query <> id")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return found.select("query", "id", "sim", place.alias("rank")).where(F.col("rank") <= k)
