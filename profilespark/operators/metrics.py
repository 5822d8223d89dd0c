"""Quality of labels in a space, and how much proteins move between conditions."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilespark.bundle import measured
from profilespark.functions.stats import bh_adjust, chi2_tail
from profilespark.session import Scratch, shuffle_partitions

#: Rows of a block. Fewer blocks move fewer copies of rows.
BLOCK = 65_536

#: Rows and columns of a tile of distances, which stays in the processor's cache.
TILE = 512


class _Side:
    """A block's rows in order of their labels, in tiles of one label each."""

    def __init__(self, t: pa.Table):
        code = t.column("code").to_numpy()
        order = np.argsort(code, kind="stable")
        vec = t.column("vec").combine_chunks()
        if len(set(pc.list_value_length(vec).unique().to_pylist())) > 1:
            raise ValueError("vectors must have one length")
        self.x = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(code), -1)[order]
        self.ids, self.code = t.column("obs_id").to_numpy(zero_copy_only=False)[order], code[order]
        self.labels, starts = np.unique(self.code, return_index=True)
        self.ends = list(zip(starts.tolist(), [*starts[1:].tolist(), len(code)]))
        self.cuts = [(k, slice(a, min(a + TILE, end))) for k, (start, end) in enumerate(self.ends) for a in range(start, end, TILE)]

    def wide(self, scale: float, swap: bool) -> np.ndarray:
        """Rows with two columns more, so that the product with the other side's is the squared distance."""
        more = [(self.x * self.x).sum(1)[:, None], np.ones((len(self.x), 1))]
        return np.concatenate((scale * self.x, *(more[::-1] if swap else more)), 1)

    def same(self, other: _Side) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """By pair of tiles the places in it that hold a row itself or two rows of one id."""
        there: dict[str, list[tuple[int, int]]] = {}
        for q, (_, cut) in enumerate(other.cuts):
            for c in range(cut.start, cut.stop):
                there.setdefault(other.ids[c], []).append((q, c - cut.start))
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for p, (_, cut) in enumerate(self.cuts):
            for r in range(cut.start, cut.stop):
                for q, c in there.get(self.ids[r], ()):
                    out.setdefault((p, q), []).append((r - cut.start, c))
        return out

    def tiles(self, other: _Side) -> Iterator[tuple[int, slice, int, slice, np.ndarray]]:
        """Place of the label and rows on this side, the same on the other, and distances, those of one id 0; each pair of tiles once."""
        x, y, same = self.wide(-2, swap=False), np.ascontiguousarray(other.wide(1, swap=True).T), self.same(other)
        for p, (k, here) in enumerate(self.cuts):
            for q, (m, there) in enumerate(other.cuts):
                if other is self and q < p:
                    continue
                d = x[here] @ y[:, there]
                np.maximum(d, 0, out=d)
                np.sqrt(d, out=d)
                for r, c in same.get((p, q), ()):
                    d[r, c] = 0
                yield k, here, m, there, d

    def sums(self, other: _Side) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the summed distances to the rows of each label of the other side, and of each row there to the labels here."""
        mine, theirs = np.zeros((len(other.labels), len(self.ids))), np.zeros((len(self.labels), len(other.ids)))
        for k, here, m, there, d in self.tiles(other):
            mine[m, here] += d.sum(1)
            if other is not self or here != there:
                theirs[k, there] += d.sum(0)
        if other is self:
            mine += theirs
        return mine.T, theirs.T


def _pairs_of_blocks(vectors: DataFrame, block: int) -> tuple[DataFrame, list[tuple[int, int]], list[str], list[int]]:
    """Rows by pair of blocks (pair, bi, bj, side 0 or 1, obs_id, code, vec), first and last code of each block, labels by
    code, rows of each.

    All pairs of rows are the result's definition; they are computed block by block, each pair of blocks once and in a
    partition of its own. Blocks follow the order of labels, so few labels are in one, and a row's sums by block are few.
    Rows with a null label or vector take no part.
    """
    spark = vectors.sparkSession
    rows = Scratch(spark, "distances").write(vectors.where("obs_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").select("obs_id", "label", "vec"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()
    n, cores = sum(r.n for r in counts), spark.sparkContext.defaultParallelism
    blocks = max(-(-n // block), min(math.ceil(math.sqrt(2 * cores)), n // 500), 1)  # a pair for each core
    first = list(itertools.accumulate((r.n for r in counts), initial=0))
    cuts = [-(-n * k // blocks) for k in range(blocks + 1)]
    codes = spark.createDataFrame([(r.label, i, first[i], r.n) for i, r in enumerate(counts)], "label string, code int, first long, n long")
    b, c = F.col("b"), F.col("c")
    place = F.floor((F.col("first") + F.pmod(F.xxhash64("obs_id"), F.col("n"))) * blocks / max(n, 1)).cast("int")
    rows = rows.join(F.broadcast(codes), "label").withColumn("b", place).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least(b, c).alias("bi"), F.greatest(b, c).alias("bj"), F.when(b <= c, 0).otherwise(1).alias("side"), "obs_id", "code", "vec")
    pair = (F.pmod(F.col("bj") - F.col("bi") - 1, F.lit(blocks)) * blocks + F.col("bi")).cast("int")  # a block with itself, which is half the work, comes last
    ranges = [(bisect.bisect_right(first, p) - 1, bisect.bisect_right(first, q - 1) - 1) for p, q in itertools.pairwise(cuts)] if n else []
    return rows.withColumn("pair", pair).repartitionById(blocks * blocks, F.col("pair")), ranges, [r.label for r in counts], [r.n for r in counts]


def _sides(t: pa.Table) -> tuple[_Side | None, _Side | None]:
    side = t.column("side").to_numpy()
    left, right = (_Side(t.filter(pa.array(side == k))) if (side == k).any() else None for k in (0, 1))
    return left, left if t.column("bi")[0] == t.column("bj")[0] else right


def silhouette(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """obs_id, label, silhouette: (b - a) / max(a, b); 0 where a row is alone in its label. vectors: obs_id, label, vec.

    A pair of blocks gives each of its rows an array of sums by label of the other block; as blocks follow the labels, a
    row's arrays over all blocks hold hardly more than one sum a label. They are put together row by row.
    """
    pairs, ranges, names, size = _pairs_of_blocks(vectors, block)
    blocks = len(ranges)

    def array(side: _Side, other: int, labels: np.ndarray, s: np.ndarray) -> pa.Table:
        first, last = ranges[other]
        full = np.zeros((len(side.ids), last - first + 1))
        full[:, labels - first] = s
        ends = pa.py_buffer(np.arange(len(full) + 1, dtype=np.int32) * np.int32(8 * full.shape[1]))
        return pa.table({"obs_id": pa.array(side.ids, pa.string()), "code": pa.array(side.code, pa.int32()), "block": pa.array(np.full(len(full), other, np.int32)), "d": pa.Array.from_buffers(pa.binary(), len(full), [None, ends, pa.py_buffer(full)])})

    def sums(t: pa.Table) -> pa.Table:
        a, b = _sides(t)
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        if a is None or b is None:
            only, other = (a, bj) if a else (b, bi)
            return array(only, other, np.array([], int), np.zeros((len(only.ids), 0)))
        mine, theirs = a.sums(b)
        out = [array(a, bj, b.labels, mine)]
        return pa.concat_tables(out if a is b else [*out, array(b, bi, a.labels, theirs)])

    def scores(t: pa.Table) -> pa.Table:
        keys: dict[tuple[str, int], int] = {}
        at = np.array([keys.setdefault(k, len(keys)) for k in zip(t.column("obs_id").to_pylist(), t.column("code").to_pylist())])
        s, block, d = np.zeros((len(keys), len(names))), t.column("block").to_numpy(), t.column("d")
        for k, (first, last) in enumerate(ranges):
            if (own := np.flatnonzero(block == k)).size:
                np.add.at(s[:, first : last + 1], at[own], np.frombuffer(b"".join(d.take(pa.array(own)).to_pylist())).reshape(len(own), -1))
        n = np.bincount(at, minlength=len(keys))[:, None] // blocks * np.array(size)  # rows of one id and label count as one
        own, me = np.array([c for _, c in keys]), np.arange(len(keys))
        more = n[me, own] > 1
        a = s[me, own] / np.where(more, n[me, own] - 1, 1)
        mean = s / n
        mean[me, own] = np.inf
        b = mean.min(1)
        top = np.maximum(a, b)
        ok = more & np.isfinite(b) & (top > 0)
        return pa.table({"obs_id": pa.array([k for k, _ in keys], pa.string()), "label": pa.array([names[c] for c in own], pa.string()), "silhouette": pa.array(np.where(ok, (np.where(ok, b, 0) - a) / np.where(ok, top, 1), 0.0))})

    each = pairs.groupBy("pair").applyInArrow(sums, "obs_id string, code int, block int, d binary")
    parts = max(shuffle_partitions(vectors.sparkSession), sum(size) * 8 * (len(names) + blocks) // 32_000_000)
    return each.groupBy(F.pmod(F.xxhash64("obs_id", F.lit("part")), F.lit(parts))).applyInArrow(scores, "obs_id string, label string, silhouette double")


def qsep(vectors: DataFrame, block: int = BLOCK // 2) -> DataFrame:
    """label, other, distance, relative: mean distance of each pair of labels (a row with itself counts as 0), and over that within.

    A distance counts for both of its rows, so each pair of blocks is computed once; only sums by pair of labels leave it.
    """
    pairs, _, names, size = _pairs_of_blocks(vectors, block)

    def sums(t: pa.Table) -> pa.Table:
        a, b = _sides(t)
        total: dict[tuple[int, int], float] = {}
        for k, here, m, there, d in a.tiles(b) if a and b else ():
            x, y, v = int(a.labels[k]), int(b.labels[m]), float(d.sum())
            for pair in ((x, y),) if a is b and here == there else ((x, y), (y, x)):
                total[pair] = total.get(pair, 0.0) + v
        out = [(names[x], names[y], v / size[x] / size[y]) for (x, y), v in total.items()]
        return pa.table({c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate((("label", pa.string()), ("other", pa.string()), ("distance", pa.float64())))})

    s = pairs.groupBy("pair").applyInArrow(sums, "label string, other string, distance double").groupBy("label", "other").agg(F.sum("distance").alias("distance"))
    own = s.where("label = other").select("label", F.col("distance").alias("w"))
    return s.join(own, "label").select("label", "other", "distance", F.when(F.col("w") > 0, F.col("distance") / F.col("w")).alias("relative"))


def calinski_harabasz(vectors: DataFrame) -> DataFrame:
    """One row: (between / (k - 1)) / (within / (n - k)). One aggregation per label and coordinate."""
    rows = vectors.where("label IS NOT NULL AND vec IS NOT NULL")
    long = rows.select("obs_id", "label", F.posexplode(F.col("vec").cast("array<double>")).alias("j", "v"))
    by = long.groupBy("label", "j").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    all_ = by.groupBy("j").agg((F.sum("s") / F.sum("n")).alias("m"))
    j = by.join(all_, "j").withColumn("b", F.col("n") * (F.col("s") / F.col("n") - F.col("m")) ** 2).withColumn("w", F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    counts = rows.groupBy("label").count().agg(F.sum("count").alias("n"), F.count("*").alias("k"))
    t = j.agg(F.sum("b").alias("b"), F.sum("w").alias("w")).join(F.broadcast(counts))
    return t.select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("score"), "n", "k")


def remodeling(a: DataFrame, b: DataFrame) -> DataFrame:
    """obs_id, score: Euclidean distance of each protein's place in two aligned embeddings (obs_id, vec)."""
    j = a.select("obs_id", F.col("vec").alias("x")).join(b.select("obs_id", F.col("vec").alias("y")), "obs_id")
    return j.select("obs_id", F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, v: s + v)).alias("score"))


def robust_estimate(x: np.ndarray, support: float = 0.75, seed: int = 0, starts: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Location and inverse scatter by the minimum covariance determinant: the tightest share of rows, found by steps
    that keep the rows nearest to the estimate, from several random starts; scaled to the median of chi-squared."""
    rng = np.random.default_rng(seed)
    n, p = x.shape
    h = max(int(support * n), (n + p + 1) // 2)
    best, kept = np.inf, np.arange(n)
    for _ in range(starts):
        rows = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(12):
            m, c = x[rows].mean(0), np.cov(x[rows], rowvar=False).reshape(p, p) + 1e-9 * np.eye(p)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argsort(d, kind="stable")[:h]
            if len(new) == len(rows) and set(new) == set(rows):
                break
            rows = new
        det = np.linalg.slogdet(np.cov(x[rows], rowvar=False).reshape(p, p) + 1e-9 * np.eye(p))[1]
        if det < best:
            best, kept = det, rows
    m, c = x[kept].mean(0), np.cov(x[kept], rowvar=False).reshape(p, p) + 1e-9 * np.eye(p)
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    median = float(np.median(d))
    chi_median = p * (1 - 2 / (9 * p)) ** 3  # of chi-squared with p degrees, to which the distances are scaled
    return m, np.linalg.inv(c) * (chi_median / median if median > 0 else 1.0)


def robust_distances(x: np.ndarray, support: float = 0.75, seed: int = 0, starts: int = 20) -> np.ndarray:
    """Squared Mahalanobis distances from the robust estimate of the same rows."""
    m, inverse = robust_estimate(x, support, seed, starts)
    return np.einsum("ij,jk,ik->i", x - m, inverse, x - m)


def condition_differences(cells: DataFrame, var: DataFrame, condition: str, replicate: str, fraction: str) -> DataFrame:
    """obs_id, replicate, profile: first condition less second, by fraction in order; all fractions must be there."""
    names = [r[0] for r in var.select(condition).where(F.col(condition).isNotNull()).distinct().orderBy(condition).limit(3).collect()]
    if len(names) != 2:
        raise ValueError("exactly two conditions are needed")
    v = var.select("var_id", F.col(condition).alias("c"), F.col(replicate).alias("replicate"), F.col(fraction).alias("f"))
    sign = F.when(F.col("c") == names[0], 1).otherwise(-1)
    diff = cells.where(measured().isNotNull()).join(v, "var_id").groupBy("obs_id", "replicate", "f").agg(F.sum(sign * F.col("x")).alias("d"), F.count_distinct("c").alias("n")).where("n = 2")
    p = diff.groupBy("obs_id", "replicate").agg(F.array_sort(F.collect_list(F.struct("f", "d"))).alias("p"))
    return p.select("obs_id", "replicate", F.transform("p", lambda s: s.d).alias("profile"))


def mr_score(cells: DataFrame, var: DataFrame, condition: str, replicate: str, fraction: str, support: float = 0.75, iterations: int = 11, sample: int = 20_000) -> DataFrame:
    """obs_id, m, r: how far a protein moves between two conditions, and how well its three replicates agree.

    Per replicate the differences' robust Mahalanobis distance gives a chi-squared tail; the median over iterations,
    the largest over replicates, cubed and adjusted is q, and m is -log10 q. r is the least correlation of two replicates.
    The location and scatter of a replicate are estimated once, on at most ``sample`` proteins drawn by a hash, and score all.
    """
    diff = condition_differences(cells, var, condition, replicate, fraction)
    reps = [r[0] for r in diff.select("replicate").distinct().orderBy("replicate").limit(4).collect()]
    if len(reps) != 3:
        raise ValueError("exactly three replicates are needed")
    size = diff.agg(F.max(F.size("profile"))).first()[0]
    diff = diff.where(F.size("profile") == size).withColumn("replicate", F.col("replicate").cast("string"))

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("obs_id")["profile"])
        fits = [robust_estimate(x, support, i) for i in range(iterations)]
        return pd.DataFrame({"replicate": pdf["replicate"].iloc[0], "m": [m.tolist() for m, _ in fits], "inverse": [v.ravel().tolist() for _, v in fits]})

    draw = F.row_number().over(Window.partitionBy("replicate").orderBy(F.xxhash64("obs_id"), "obs_id"))
    drawn = diff.withColumn("draw", draw).where(F.col("draw") <= sample).drop("draw")
    fits: dict = {}
    for row in drawn.groupBy("replicate").applyInPandas(estimate, "replicate string, m array<double>, inverse array<double>").collect():  # a few rows a replicate
        fits.setdefault(row.replicate, []).append((np.array(row.m), np.array(row.inverse).reshape(size, size)))
    shared = cells.sparkSession.sparkContext.broadcast(fits)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["profile"]) if len(pdf) else np.zeros((0, size))
            d2 = np.full(len(pdf), np.nan)
            for name in pdf["replicate"].unique():
                at = (pdf["replicate"] == name).to_numpy()
                d2[at] = np.median([np.einsum("ij,jk,ik->i", x[at] - m, v, x[at] - m) for m, v in shared.value[str(name)]], axis=0)
            yield pd.DataFrame({"obs_id": pdf["obs_id"], "d2": d2})

    d2 = diff.mapInPandas(score, "obs_id string, d2 double")
    p = d2.withColumn("p", chi2_tail("d2", int(size))).groupBy("obs_id").agg(F.max("p").alias("p"), F.count("*").alias("n")).where("n = 3")
    q = bh_adjust(p.withColumn("p3", F.pow("p", F.lit(3.0))), "p3", "q")
    wide = diff.groupBy("obs_id").pivot("replicate", reps).agg(F.first("profile"))

    def corr(a: str, b: str):
        x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
        mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / size
        dot = lambda c, e: F.aggregate(F.zip_with(c, e, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
        sxy, sxx, syy = dot(x, y) - size * mean(x) * mean(y), dot(x, x) - size * mean(x) * mean(x), dot(y, y) - size * mean(y) * mean(y)
        return F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))

    r = wide.select("obs_id", F.least(*[corr(str(a), str(b)) for a, b in itertools.combinations(reps, 2)]).alias("r"))
    return q.join(r, "obs_id").select("obs_id", (-F.log10(F.col("q") + 2.2e-308)).alias("m"), "r")


def transitions(a: DataFrame, b: DataFrame) -> DataFrame:
    """label_a, label_b, n: how labels (obs_id, label) go over into each other."""
    return a.select("obs_id", F.col("label").alias("label_a")).join(b.select("obs_id", F.col("label").alias("label_b")), "obs_id").groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


def rank_groups(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """label, var_id, t, df: each label against the rest by Welch's t, from one aggregation of moments."""
    j = cells.where(measured().isNotNull()).join(labels.where("label IS NOT NULL"), "obs_id")
    by = j.groupBy("label", "var_id").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    w = Window.partitionBy("var_id")
    by = by.withColumn("n0", F.sum("n").over(w) - F.col("n")).withColumn("s0", F.sum("s").over(w) - F.col("s")).withColumn("q0", F.sum("q").over(w) - F.col("q"))
    by = by.where("n > 1 AND n0 > 1").withColumn("v", (F.col("q") - F.col("s") ** 2 / F.col("n")) / (F.col("n") - 1) / F.col("n")).withColumn("v0", (F.col("q0") - F.col("s0") ** 2 / F.col("n0")) / (F.col("n0") - 1) / F.col("n0"))
    se = F.col("v") + F.col("v0")
    return by.where(se > 1e-12).select("label", "var_id", ((F.col("s") / F.col("n") - F.col("s0") / F.col("n0")) / F.sqrt(se)).alias("t"), (se * se / (F.col("v") ** 2 / (F.col("n") - 1) + F.col("v0") ** 2 / (F.col("n0") - 1))).alias("df"))
