"""Spark session helpers.

The library never creates hidden sessions inside operators; callers pass a
``SparkSession`` or a DataFrame.  ``get_session`` is a convenience for tests,
the bench and scripts.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "churnscope", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Return a session tuned for this workload.

    On a cluster the master and most sizes come from ``spark-submit``; here we
    only set what the plans rely on: AQE (runtime coalescing, skew-join
    splitting, broadcast conversion of small join sides), UTC dates and no UI.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.caseSensitive": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("CHURNSCOPE_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder on the storage every executor shares.

    Uses the cluster's ``spark.checkpoint.dir`` (or a checkpoint folder set on
    the context).  Only a local-mode session with neither (tests) gets a fresh
    scratch folder; on a cluster a missing setting is an error, so lineage
    cuts and written intermediates never land on a machine-local path.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor shares "
                               "(e.g. on the cluster's object store or HDFS)")
        base = tempfile.mkdtemp(prefix="churnscope-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    if not parts:
        return base
    return "/".join([base.rstrip("/"), *parts])


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: a reliable checkpoint in the shared checkpoint folder.

    For small results that several outputs read (predictions, model frames),
    so each output does not re-run the ledger plan, and a lost executor
    does not send recovery back to the scan.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`fresh_path` named, wherever Spark keeps it."""
    if not path.startswith(shared_dir(spark).rstrip("/") + "/"):
        raise ValueError("not a folder of this session's shared folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unique folder name under :func:`shared_dir`."""
    return shared_dir(spark, f"{label}-{uuid.uuid4().hex[:12]}")
