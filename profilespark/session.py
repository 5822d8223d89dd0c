"""Session helpers: shared scratch tables, size-checked broadcasts, partition counts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def local_session(cores: int = 8, app: str = "profilespark", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, so that they need no copy of it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        made = tempfile.mkdtemp(prefix="profilespark-package-")
        copy = Path(made) / "package" / root.name
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        sc.addPyFile(shutil.make_archive(f"{made}/profilespark", "zip", copy.parent))
        _shipped.add(sc.applicationId)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where the session names none, one is made on a single machine only.

    A folder of one machine would hold but a part of a table on a cluster, so there the setting must be given.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="profilespark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_roots: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def release_all() -> None:
    """Deletes all scratch tables of this driver."""
    while _roots:
        with contextlib.suppress(Exception):  # the session may be gone, and the folder with it
            _delete(*_roots.pop())


class Scratch:
    """Written tables that cut lineage; each lives in the shared folder until it is released.

    A lost executor costs only the tasks it ran, as the tables are files that all executors share. What was not released
    goes when the driver ends, or earlier by ``release_all``, once the results that read it are written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _roots.append((spark, self.root))

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.mode("errorifexists").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                _delete(self.spark, path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted rows are within the limit; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
