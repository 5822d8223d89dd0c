"""Tails of distributions, adjusted p-values, entropy. Series run in numpy batches where Spark has no such function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LANCZOS = np.array([0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0."""
    x = np.asarray(x, float) - 1
    s = _LANCZOS[0] + sum(c / (x + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(s)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def gamma_inc_upper(a: np.ndarray, x: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(x) - log_gamma(a))
    term = 1 / a
    total = term.copy()
    for n in range(1, rounds):
        term = term * x / (a + n)
        total = total + term
    b = x + 1 - a
    c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for i in range(1, rounds):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


def t_sf2(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_inc_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    n, k = np.asarray(n, float), np.asarray(k, float)
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def hypergeom_sf(k: int, population: int, marked: int, drawn: int) -> float:
    """Chance of k or more marked ones among those drawn."""
    hi = min(marked, drawn)
    if k > hi:
        return 0.0
    i = np.arange(max(k, drawn - (population - marked), 0), hi + 1)
    if not len(i):
        return 0.0
    return float(min(1.0, np.exp(log_choose(marked, i) + log_choose(population - marked, drawn - i) - log_choose(population, drawn)).sum()))


def hypergeom_sf_many(k: np.ndarray, population: np.ndarray, marked: np.ndarray, drawn: np.ndarray, cells: int = 2_000_000) -> np.ndarray:
    """``hypergeom_sf`` of many rows, as sums over the rows of a matrix; rows of like length go together."""
    k, n, m, d = (np.asarray(v, np.int64) for v in (k, population, marked, drawn))
    out = np.zeros(len(k))
    if not len(k):
        return out
    low = np.maximum(k, np.maximum(0, d - (n - m)))
    length = np.maximum(0, np.minimum(m, d) - low + 1)
    top = int(n.max())
    table = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, top + 1))))) if top <= 5_000_000 else None
    lf = (lambda x: table[x]) if table is not None else (lambda x: log_gamma(x + 1.0))
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    at = 0
    while at < len(order):
        step = max(1, min(len(order) - at, cells // int(length[order[min(len(order) - 1, at + 4095)]])))
        rows = order[at : at + min(step, 4096)]
        at += len(rows)
        off = np.arange(int(length[rows].max()))[None]
        ok = off < length[rows][:, None]
        i = np.where(ok, low[rows][:, None] + off, low[rows][:, None])
        N, M, D = n[rows][:, None], m[rows][:, None], d[rows][:, None]
        lp = lf(M) - lf(i) - lf(M - i) + lf(N - M) - lf(D - i) - lf(N - M - D + i) - lf(N) + lf(D) + lf(N - D)
        out[rows] = np.where(ok, np.exp(lp), 0.0).sum(1)
    return np.minimum(out, 1.0)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of [[a, b], [c, d]]: the tables at most as likely as this one."""
    n, row, col = a + b + c + d, a + b, a + c
    i = np.arange(max(0, row + col - n), min(row, col) + 1)
    lp = log_choose(col, i) + log_choose(n - col, row - i) - log_choose(n, row)
    mine = lp[a - i[0]]
    return float(min(1.0, np.exp(lp[lp <= mine + 1e-7]).sum()))


def t_two_sided(t: str, df: str) -> Column:
    @F.pandas_udf(T.DoubleType())
    def f(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & df.notna() & (df > 0)
        out = pd.Series(np.nan, index=t.index)
        if ok.any():
            out[ok] = t_sf2(t[ok].to_numpy(), df[ok].to_numpy())
        return out.astype(object).where(ok, None)

    return f(F.col(t).cast("double"), F.col(df).cast("double"))


def chi2_tail(x: str, df: int) -> Column:
    @F.pandas_udf(T.DoubleType())
    def f(x: pd.Series) -> pd.Series:
        ok = x.notna()
        out = pd.Series(np.nan, index=x.index)
        if ok.any():
            out[ok] = chi2_sf(x[ok].to_numpy(), df)
        return out.astype(object).where(ok, None)

    return f(F.col(x).cast("double"))


def hypergeom_tail(k: str, population: str, marked: str, drawn: str) -> Column:
    @F.pandas_udf(T.DoubleType())
    def f(k: pd.Series, n: pd.Series, m: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hypergeom_sf_many(k.to_numpy(), n.to_numpy(), m.to_numpy(), d.to_numpy()))

    return f(k, population, marked, drawn)


def bh_adjust(df: DataFrame, p: str, out: str = "q", by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: p times n over its rank, made monotone from the largest down, at most 1. Null p stay null.

    Within each group of ``by``; a group's p-values are put in order in one task. Without ``by`` ranks come from
    distinct p-values and their counts, so equal p-values of many rows are one row of the ordered window.
    """
    keys = by or []
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    down = Window.partitionBy(*keys).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = counts.withColumn("_r", F.sum("_c").over(up)).withColumn("_n", F.sum("_c").over(all_))
    q = q.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down))).select(*keys, p, out)
    return df.join(q, [*keys, p], "left")


def entropy(probabilities: Column) -> Column:
    """Of an array of probabilities, in nats; values below 1e-12 count as that."""
    return -F.aggregate(probabilities, F.lit(0.0), lambda acc, x: acc + F.greatest(x, F.lit(1e-12)) * F.log(F.greatest(x, F.lit(1e-12))))


def longest_common(a: Column, b: Column) -> Column:
    """How many elements two arrays share."""
    return F.size(F.array_intersect(a, b))
