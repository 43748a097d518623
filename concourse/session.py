"""Session construction and shared-storage helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "concourse") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Constraint inference through the expression-heavy text and schedule projections
        # dominates their planning; the plans state their filters themselves.
        .config("spark.sql.constraintPropagation.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CONCOURSE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Written folders of this process by application, so that they can be removed.
_SCRATCH: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``), read from the session.

    Only a local session without one (tests, the bench) gets a folder of its own: there
    driver and executors are one process. On a cluster a missing setting is an error, as a
    machine-local folder would not be seen by the other machines."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    ckpt = spark.sparkContext.getCheckpointDir()
    if ckpt:
        # getCheckpointDir returns <dir>/<uuid>; use its parent as the shared root.
        return ckpt.rstrip("/").rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all machines share")
    local = tempfile.mkdtemp(prefix="concourse-shared-")
    spark.sparkContext.setCheckpointDir(local)
    return shared_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared folder; ``release`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what was written under ``scratch_path`` inside. Results must have been
    consumed by then."""
    paths = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    before = len(paths)
    try:
        yield
    finally:
        _remove(spark, paths[before:])
        del paths[before:]


def release(spark: SparkSession) -> None:
    """Removes all that this application wrote under ``scratch_path``."""
    _remove(spark, _SCRATCH.pop(spark.sparkContext.applicationId, []))


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        remove(spark, p)


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    store, p = _store(spark, path)
    store.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _store(spark, path)
    return store.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it is not there."""
    store, p = _store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(p) if x.isDirectory()] if store.exists(p) else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; callers select columns so the scan is pruned."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ROWS_PER_TASK = 100_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Round-robin a scan over tasks of about ROWS_PER_TASK rows, one for each core at least, when it has fewer splits (a
    file of few row groups would otherwise run a whole row-local pipeline in few tasks, which grow with the input).
    Inputs made of many files/row groups already have enough splits and are returned unchanged."""
    target = tasks_for(df, df.count() if rows is None else rows)
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def tasks_for(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts lineage and
    survives the loss of the executors that computed it. Use for small derived dimensions."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
