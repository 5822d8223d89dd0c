"""Imputation, principal components, exact neighbours in blocks, fuzzy neighbour weights, joint embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilespark.bundle import SpatialDataset, measured, present

BLOCK = 4000


def _uniform(*keys) -> F.Column:
    """A number in (0, 1) that depends on the keys alone, so it is the same however rows are partitioned."""
    return (F.pmod(F.xxhash64(*keys), F.lit(2**52)) + 0.5) / 2.0**52


def grid(ds: SpatialDataset, samples: DataFrame) -> DataFrame:
    """Every protein with every sample of its dataset, with the columns of samples (var_id, ...).

    Where proteins or samples name no dataset the bundle is one matrix, and the counted table of samples is broadcast.
    """
    obs = ds.obs.select("obs_id", *(["dataset"] if "dataset" in ds.obs.columns and "dataset" in ds.var.columns else [])).distinct()
    if "dataset" in obs.columns:
        return obs.join(samples.join(ds.var.select("var_id", "dataset").distinct(), "var_id"), "dataset").drop("dataset")
    if samples.limit(BLOCK * 10 + 1).count() > BLOCK * 10:
        raise ValueError("too many samples in one matrix; give proteins and samples a dataset")
    return obs.withColumn("_one", F.lit(1)).join(F.broadcast(samples.withColumn("_one", F.lit(1))), "_one").drop("_one")


def impute_gaussian(ds: SpatialDataset, width: float = 0.3, distance: float = 1.8, per_sample: bool = True, seed: int = 0) -> SpatialDataset:
    """Missing values drawn from N(mean - distance * std, (width * std)^2) of the sample's (or all) measured values.

    Every protein gets a cell in every sample of its dataset. Draws come from a hash of seed, protein and sample by
    Box-Muller. obs gets n_imputed.
    """
    stats = (ds.cells.groupBy("var_id") if per_sample else ds.cells.groupBy()).agg(F.avg(measured()).alias("_m"), F.stddev_pop(measured()).alias("_s"))
    samples = ds.var.select("var_id").distinct()
    samples = samples.join(stats, "var_id") if per_sample else samples.join(F.broadcast(stats))
    every = grid(ds, samples)
    u, v = _uniform(F.lit(seed), "obs_id", "var_id", F.lit("u")), _uniform(F.lit(seed), "obs_id", "var_id", F.lit("v"))
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)
    full = every.join(ds.cells, ["obs_id", "var_id"], "left")
    draw = F.col("_m") - distance * F.col("_s") + width * F.col("_s") * z
    full = full.withColumn("imputed", ~F.coalesce(present(), F.lit(False))).withColumn("x", F.when(F.col("imputed"), draw).otherwise(F.col("x"))).drop("_m", "_s")
    n = full.groupBy("obs_id").agg(F.count_if("imputed").alias("n_imputed"))
    return ds.with_(cells=full, obs=ds.obs.drop("n_imputed").join(n, "obs_id", "left"))


def impute_knn(ds: SpatialDataset, k: int = 20, block: int = 1500) -> SpatialDataset:
    """Missing values as the mean over the k nearest proteins that have the sample, else the sample's mean.

    The distance of two proteins is over samples both have, scaled up by all over shared. Every protein with a gap is
    compared with all others, block by block; of each block and sample only the k best candidates leave it.
    """
    samples = [r[0] for r in ds.var.select("var_id").distinct().orderBy("var_id").collect()]
    col = {v: i for i, v in enumerate(samples)}
    p = len(samples)
    rows = ds.cells.where(present()).groupBy("obs_id").agg(F.collect_list(F.struct("var_id", "x")).alias("e"))
    rows = ds.obs.select("obs_id").distinct().join(rows, "obs_id", "left").withColumn("e", F.coalesce("e", F.expr("array()").cast("array<struct<var_id:string,x:double>>")))
    blocks = max(1, -(-ds.obs.count() // block))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("obs_id"), F.lit(blocks)))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.where(F.size("e") < p).withColumn("c", each).select(F.col("b").alias("bi"), F.col("c").cast("long").alias("bj"), F.lit(0).alias("side"), "obs_id", "e")
    right = rows.withColumn("c", each).select(F.col("c").cast("long").alias("bi"), F.col("b").alias("bj"), F.lit(1).alias("side"), "obs_id", "e")

    def dense(part: pd.DataFrame) -> np.ndarray:
        x = np.full((len(part), p), np.nan)
        for i, e in enumerate(part["e"]):
            for s in e:
                x[i, col[s["var_id"]]] = s["x"]
        return x

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = []
        if len(a) and len(b):
            xa, xb = dense(a), dense(b)
            ma, mb = ~np.isnan(xa), ~np.isnan(xb)
            za, zb = np.nan_to_num(xa), np.nan_to_num(xb)
            shared = ma.astype(float) @ mb.T
            d2 = (za * za) @ mb.T + ma @ (zb * zb).T - 2 * za @ zb.T
            with np.errstate(all="ignore"):
                d = np.where(shared > 0, np.sqrt(np.maximum(d2, 0) * p / shared), np.inf)
            d[a["obs_id"].to_numpy()[:, None] == b["obs_id"].to_numpy()[None]] = np.inf
            ids = b["obs_id"].to_numpy()
            for i, name in enumerate(a["obs_id"]):
                order = np.lexsort((ids, d[i]))
                order = order[np.isfinite(d[i][order])]
                for j in np.flatnonzero(~ma[i]):
                    best = order[mb[order, j]][:k]
                    out += [(name, samples[j], float(d[i, o]), ids[o], float(xb[o, j])) for o in best]
        return pd.DataFrame(out, columns=["obs_id", "var_id", "d", "donor", "v"])

    near = left.unionByName(right).groupBy("bi", "bj").applyInPandas(run, "obs_id string, var_id string, d double, donor string, v double")
    rank = F.row_number().over(Window.partitionBy("obs_id", "var_id").orderBy("d", "donor"))
    fill = near.withColumn("r", rank).where(F.col("r") <= k).groupBy("obs_id", "var_id").agg(F.avg("v").alias("_f"))
    means = ds.cells.groupBy("var_id").agg(F.avg(measured()).alias("_m"))
    every = grid(ds, ds.var.select("var_id").distinct().join(means, "var_id", "left"))
    full = every.join(ds.cells, ["obs_id", "var_id"], "left").join(fill, ["obs_id", "var_id"], "left")
    full = full.withColumn("imputed", ~F.coalesce(present(), F.lit(False))).withColumn("x", F.when(F.col("imputed"), F.coalesce("_f", "_m")).otherwise(F.col("x")))
    return ds.with_(cells=full.drop("_f", "_m"))


def covariance(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of vec, from one pass with partial sums per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([q.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s", "q"])

    parts = vectors.select("vec").where(F.size("vec") == dim).mapInArrow(run, "n long, s array<double>, q array<double>")
    long = parts.select("n", F.posexplode(F.concat("s", "q")).alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    rows = {r.j: (r.v, r.n) for r in long.collect()}
    n = rows[0][1] if rows else 0
    s = np.array([rows[j][0] for j in range(dim)])
    q = np.array([rows[dim + j][0] for j in range(dim * dim)]).reshape(dim, dim)
    return n, s / n, (q - np.outer(s, s) / n) / max(1, n - 1)


def principal_components(vectors: DataFrame, dim: int, k: int = 2) -> DataFrame:
    """obs_id, pcs: coordinates along the k directions of largest variance; a direction's largest weight is positive."""
    _, mean, cov = covariance(vectors, dim)
    w, v = np.linalg.eigh(cov)
    v = v[:, np.argsort(-w, kind="stable")[:k]]
    v = v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((x - mean) @ v).tolist(), pa.list_(pa.float64()))], ["obs_id", "pcs"])

    return vectors.select("obs_id", "vec").where(F.size("vec") == dim).mapInArrow(run, "obs_id string, pcs array<double>")


def exact_neighbours(vectors: DataFrame, k: int = 15, block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """src, dst, dist, rank: the k nearest rows by Euclidean distance, of each row or of the queries.

    Block by block: each pair of blocks in a task, from which the k nearest of each query leave.
    """
    rows = vectors.where("obs_id IS NOT NULL AND vec IS NOT NULL").select("obs_id", F.col("vec").cast("array<double>").alias("vec"))
    asked = rows if queries is None else queries.where("obs_id IS NOT NULL AND vec IS NOT NULL").select("obs_id", F.col("vec").cast("array<double>").alias("vec"))
    blocks = max(1, -(-rows.count() // block))
    b = F.pmod(F.xxhash64("obs_id"), F.lit(blocks))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = asked.withColumn("c", each).select(b.alias("bi"), F.col("c").cast("long").alias("bj"), F.lit(0).alias("side"), "obs_id", "vec")
    right = rows.withColumn("c", each).select(F.col("c").cast("long").alias("bi"), b.alias("bj"), F.lit(1).alias("side"), "obs_id", "vec")

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids = np.array(t.column("obs_id").to_pylist(), object)
        x = np.stack([np.asarray(v, float) for v in t.column("vec").to_pylist()])
        xa, xb, ia, ib = x[side == 0], x[side == 1], ids[side == 0], ids[side == 1]
        src, dst, dist = [], [], []
        for i in range(0, len(xa), 500):
            if not len(xb):
                break
            p = xa[i : i + 500]
            d = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (xb * xb).sum(1)[None] - 2 * p @ xb.T, 0))
            d[ia[i : i + 500][:, None] == ib[None]] = np.inf
            m = min(k, len(xb))
            top = np.argpartition(d, m - 1, axis=1)[:, :m]
            for r, c in enumerate(top):
                c = c[np.isfinite(d[r, c])]
                src += [ia[i + r]] * len(c)
                dst += ib[c].tolist()
                dist += d[r, c].tolist()
        return pa.table({"src": pa.array(src, pa.string()), "dst": pa.array(dst, pa.string()), "dist": pa.array(dist, pa.float64())})

    parts = left.unionByName(right).groupBy("bi", "bj").applyInArrow(run, "src string, dst string, dist double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def fuzzy_weights(neighbours: DataFrame) -> DataFrame:
    """src, dst, dist, w from src, dst, dist: membership exp(-(d - nearest) / sigma) with sigma such that a row's sum is
    log2 k, then a + b - ab over both directions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf["dist"].to_numpy()
        rho = d[d > 0].min() if (d > 0).any() else 0.0
        lo, hi, target = 0.0, np.inf, np.log2(len(d) + 1)
        sigma = 1.0
        for _ in range(64):
            s = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
            if abs(s - target) < 1e-5:
                break
            if s > target:
                hi = sigma
                sigma = (lo + hi) / 2
            else:
                lo = sigma
                sigma = sigma * 2 if hi == np.inf else (lo + hi) / 2
        sigma = max(sigma, 1e-3 * d.mean()) or 1.0
        return pdf.assign(w=np.exp(-np.maximum(d - rho, 0) / sigma))

    one = neighbours.select("src", "dst", "dist").groupBy("src").applyInPandas(run, "src string, dst string, dist double, w double")
    back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dist").alias("d2"), F.col("w").alias("w2"))
    j = one.join(back, ["src", "dst"], "full")
    a, b = F.coalesce("w", F.lit(0.0)), F.coalesce("w2", F.lit(0.0))
    return j.select("src", "dst", F.coalesce("dist", "d2").alias("dist"), (a + b - a * b).alias("w"))


def aligned_embedding(sets: list[DataFrame], dim: int, k: int = 2) -> list[DataFrame]:
    """obs_id, vec of each set: components of the sets' common mean profile, each set turned onto it (Procrustes).

    Stands for the joint non-linear embedding, of which it keeps that equal profiles lie at equal places.
    """
    ids = sets[0].select("obs_id")
    for s in sets[1:]:
        ids = ids.intersect(s.select("obs_id"))
    sets = [s.join(ids, "obs_id", "left_semi") for s in sets]
    all_ = sets[0].select("vec")
    for s in sets[1:]:
        all_ = all_.unionByName(s.select("vec"))
    _, mean, cov = covariance(all_, dim)
    w, v = np.linalg.eigh(cov)
    v = v[:, np.argsort(-w, kind="stable")[:k]]
    v = v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(((x - mean) @ v).tolist(), pa.list_(pa.float64()))], ["obs_id", "vec"])

    return [s.select("obs_id", "vec").mapInArrow(run, "obs_id string, vec array<double>") for s in sets]


def sample_correlation(ds: SpatialDataset) -> DataFrame:
    """a, b, r: Pearson's correlation of each pair of samples of one dataset over the proteins both have."""
    c = ds.cells.where(present()).join(ds.var.select("var_id", "dataset"), "var_id").where("dataset IS NOT NULL")
    left, right = c.select("dataset", "obs_id", F.col("var_id").alias("a"), F.col("x")), c.select("dataset", "obs_id", F.col("var_id").alias("b"), F.col("x").alias("y"))
    return left.join(right, ["dataset", "obs_id"]).where("a <= b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
