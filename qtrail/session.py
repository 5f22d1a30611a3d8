"""Session helpers: a test/bench session and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def _context(spark: SparkSession):
    """The SparkContext, or None on a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001
        return None


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a
    cluster it is installed or sent with --py-files)."""
    sc, root = _context(spark), str(Path(__file__).resolve().parents[1])
    if sc is None:
        return
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``), if any."""
    sc = _context(spark)
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured:
            return configured
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint folder; create a private one only in local mode."""
    configured = checkpoint_dir(spark)
    sc = _context(spark)
    if sc is None:
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        return configured
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="qtrail-ckpt-"))
    return sc.getCheckpointDir()


def parallelism(spark: SparkSession) -> int:
    """Cores of the cluster (default parallelism), from the context or the conf."""
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.default.parallelism", spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for intermediate tables."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df, name: str = "table"):
    """Compute ``df`` once and cut its lineage: write it as Parquet to a fresh
    folder under the shared checkpoint folder; the table read back, and its path
    for ``drop_stored`` once no later plan reads it.

    One job (an eager ``checkpoint()`` runs the plan twice unless cached), the
    copy is columnar so later reads prune columns, its file size is known to
    the planner, and it survives executor loss (never a local checkpoint)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    sc = _context(spark)
    if sc is None:
        return  # no file system handle (Spark Connect): the folder's owner cleans it
    for path in paths:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df, name: str = "table"):
    """``stored`` without the path, for tables that the result itself reads."""
    return stored(df, name)[0]


def spread(df):
    """Give CPU-bound per-row work at least one partition per core.

    A small input (one file, one row group) arrives as a single partition and
    would run every per-line regex in one task.  Large inputs already have at
    least ``defaultParallelism`` splits and are returned unchanged (no shuffle)."""
    target = parallelism(df.sparkSession)
    try:
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (Spark Connect): leave as is
        return df
    return df.repartition(target) if parts < target else df


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "qtrail") -> SparkSession:
    """Session used by tests and the bench (the library itself never builds one)."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC")
             # many short jobs: let the context cleaner drop finished shuffles and
             # broadcasts every minute instead of every 30 minutes
             .config("spark.cleaner.periodicGC.interval", "1min")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark
