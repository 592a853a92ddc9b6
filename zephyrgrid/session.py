"""Session helpers: the shared folder, guarded joins and cuts of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only after its row count was found to be at most this.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("zephyrgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def local_master(master: str) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` is not."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where that setting is missing, a fresh local folder is made for a local master; on a cluster, whose
    executors would each write to a folder of their own, it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if current.isEmpty():
        if not local_master(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="zephyrgrid-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a table, in the shared folder, that nobody has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stable(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it from there.

    Values that a second run could draw or place otherwise are fixed once, the plan behind them
    is cut, and a lost executor costs a re-read. Unlike ``checkpoint`` the last stage runs once,
    and later readers fetch only the columns they need.
    """
    path = new_folder(df.sparkSession, "stable")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, side: DataFrame, on: list[str], how: str = "left",
           limit: int = BROADCAST_ROWS, counted: DataFrame | int | None = None) -> DataFrame:
    """Equi-join with a side table that is broadcast only if it is counted to be small.

    Beyond the limit the join stays a shuffle join, which adaptive execution splits on skew.
    ``counted`` is the row count, or a cheaper table with at least as many rows.
    """
    rows = counted if isinstance(counted, int) else (side if counted is None else counted).limit(limit + 1).count()
    if rows <= limit:
        side = F.broadcast(side)
    return df.join(side, on, how)


def together(spark: SparkSession, jobs: dict, workers: int = 4) -> dict:
    """The results by name of functions that do not need each other's; a few are in flight at once."""
    ship(spark)  # once, before any of them does
    with ThreadPoolExecutor(workers) as pool:
        return dict(zip(jobs, pool.map(lambda job: job(), jobs.values())))


_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once per application, for workers that don't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "zephyrgrid.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
