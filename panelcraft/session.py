"""Spark session defaults and the shared checkpoint folder.

The library never creates a session on its own inside an operator; plans and
tests call :func:`build_session` once and pass the session around.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan relies on: UTC calendar arithmetic, adaptive execution
# (runtime broadcast conversion, partition coalescing, skew-join splitting),
# no web UI.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # joins on (id, year, quarter) may reuse a partitioning by id alone: panels keep
    # one shuffle by entity through windows, roll-ups and keyed joins
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "panelcraft",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; a scratch one is made in local mode only.

    On a cluster ``spark.checkpoint.dir`` names a folder that all executors
    share. A machine-local folder would lose what other machines write, so
    without that setting this raises unless the master is local.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="panelcraft-ckpt-"))
    return sc.getCheckpointDir()


def scratch_table_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint directory for intermediate tables; no two calls share one."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex}")


def materialise(df, name: str = "stage", **options):
    """Compute ``df`` once into a parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but in one pass (an unpersisted
    reliable checkpoint computes its input twice), stores columnar data, and
    gives adaptive execution real sizes. Survives executor loss: the files
    live in the cluster's shared checkpoint folder.
    """
    return written(df, name, **options)[0]


def written(df, name: str = "stage", **options):
    """As :func:`materialise`, with the table's folder, for :func:`release_tables` when it isn't needed any more."""
    path = scratch_table_dir(df.sparkSession, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    _MATERIALISED.append(path)
    return df.sparkSession.read.parquet(path), path


_MATERIALISED: list[str] = []


def materialised() -> list[str]:
    """Folders of the tables :func:`materialise` wrote in this process and that were not released."""
    return list(_MATERIALISED)


def release_tables(spark: SparkSession, paths: list[str]) -> int:
    """Delete some of those tables; returns how many were there. No frame that reads them may be used any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for path in paths:
        if path in _MATERIALISED:
            _MATERIALISED.remove(path)
            p = jvm.org.apache.hadoop.fs.Path(path)
            fs = p.getFileSystem(conf)
            removed += int(fs.exists(p) and bool(fs.delete(p, True)))
    return removed


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, which otherwise stay until the driver's next full collection."""
    gc.collect()  # Python's handles of plans first
    spark.sparkContext._jvm.java.lang.System.gc()


def release_materialised(spark: SparkSession) -> int:
    """Delete the tables :func:`materialise` wrote in this process; returns how many were removed.

    Call only once every DataFrame read from them has been consumed (lazy
    frames read the files when they run). Deletion goes through the cluster's
    Hadoop file system, so it works for any shared checkpoint folder.
    """
    return release_tables(spark, materialised())
