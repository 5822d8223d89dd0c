"""Shared helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows hashed over all cores where the scan has fewer partitions than the cluster has cores.

    Work per row is heavy in Python, and a small input is often one file; a large one is left as it is scanned.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, key) if df.rdd.getNumPartitions() < 2 * cores else df
