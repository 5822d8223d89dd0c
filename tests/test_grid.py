"""Imputation stays within a dataset where proteins and samples name theirs."""

from profilespark.bundle import SpatialDataset
from profilespark.operators import space as V


def test_grid_within_dataset(spark):
    cells = spark.createDataFrame([("p", "a1", 1.0), ("p", "a2", 3.0), ("q", "b1", 5.0), ("r", "a1", 2.0)], "obs_id string, var_id string, x double")
    obs = spark.createDataFrame([("p", 0, "A"), ("q", 1, "B"), ("r", 2, "A")], "obs_id string, obs_pos int, dataset string")
    var = spark.createDataFrame([("a1", 0, "A"), ("a2", 1, "A"), ("b1", 0, "B"), ("pool", 2, None)], "var_id string, var_pos int, dataset string")
    got = {(r.obs_id, r.var_id) for r in V.impute_gaussian(SpatialDataset(cells, obs, var)).cells.collect()}
    assert got == {("p", "a1"), ("p", "a2"), ("r", "a1"), ("r", "a2"), ("q", "b1")}
