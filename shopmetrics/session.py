"""Session construction and the shared scratch folder.

The library never sets cluster sizing itself; ``build_session`` only fills
in what the reports need for correct answers (UTC, ANSI) and the
adaptive-execution switches that handle skew and partition sizing at run
time. On a cluster, pass an existing session instead.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every report relies on for its results, not for speed.
CORRECTNESS_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Adaptive execution: coalesce small shuffle partitions, split skewed
# join partitions, and switch to broadcast only from measured sizes.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


# Planning speed: PySpark records the Python call site of every Column
# function for error messages, at several JVM round trips per call; report
# plans build hundreds of expressions, so this is switched off.
PLANNING_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Deletes a query's shuffle files when it ends; ``materialize`` sets it for its own write only.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    master: str | None = None,
    app_name: str = "shopmetrics",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {**CORRECTNESS_CONF, **ADAPTIVE_CONF, **PLANNING_CONF, "spark.ui.enabled": "false"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_report_conf(spark)
    return spark


def apply_report_conf(spark: SparkSession) -> None:
    """Set the correctness settings on an existing session."""
    for k, v in CORRECTNESS_CONF.items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide scratch folder named by ``spark.checkpoint.dir``.

    When the session does not name one (local tests), a fresh local
    folder is created and registered; on a cluster the setting must be
    present, since a machine-local folder is not visible to executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local context (Spark Connect)
        sc = None
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if sc is None or not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    path = tempfile.mkdtemp(prefix="shopmetrics-")
    sc.setCheckpointDir(path)
    return path


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "shopmetrics", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder, in a folder of this application."""
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def remove_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application. DataFrames that were read from one cannot be evaluated any more."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared folder and read it back.

    For a caller that runs several reports over the same cleaned table
    (a dashboard refresh): later reports start from the written table, the
    lineage is cut, and a lost executor costs a re-read, not a recompute.
    The shuffle files of the write are deleted as soon as it has ended, so a
    job of many steps holds those of one step at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


def discard(written) -> None:
    """Delete the table of a DataFrame that ``materialize`` has returned. What reads it cannot be evaluated any more."""
    spark = written.sparkSession
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).getParent().toString() for f in written.inputFiles()}:
        table = jvm.org.apache.hadoop.fs.Path(folder)
        if not files.makeQualified(table.getParent()).equals(files.makeQualified(root)):
            raise ValueError(f"{folder} is not a scratch table of this application")
        files.delete(table, True)
