"""Session construction and the shared work folder.

Lineage cuts and streaming checkpoints go to the folder the cluster names in
``spark.checkpoint.dir``. Only a local session (tests, bench) without that
setting gets a private temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files of lineage cuts once their data is unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "flowsieve", extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Operators assume UTC wall-clock semantics.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _is_local(spark: SparkSession) -> bool:
    """One JVM on one machine (``local-cluster`` has executors of its own)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from ``spark.checkpoint.dir``; a local session without it gets a
    fresh temporary folder (never used on a cluster).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="flowsieve-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


_made: list[str] = []


def written(df, name: str):
    """The rows, written once as Parquet below the checkpoint folder and read
    from there: lineage ends, later passes read only the columns they need."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_work_dirs(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Call it when no
    DataFrame that reads them is needed any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    while _made:
        path = hadoop.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def work_dir(spark: SparkSession, name: str) -> str:
    """The path of a new, unique sub-folder of the checkpoint root for one
    job; whatever writes there creates it."""
    _made.append(f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]
