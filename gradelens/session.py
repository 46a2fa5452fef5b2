"""Spark session helpers.

Library code never creates its own session: every operator takes the caller's
``SparkSession`` (or a DataFrame).  ``local_session`` is for tests, the bench
and the CLI; on a cluster the submitter's session is used as it is.
"""
from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "gradelens") -> SparkSession:
    """A local session configured the way the library expects a cluster to be.

    * AQE on (coalesces small shuffle partitions, splits skewed join
      partitions at run time, turns a join into a broadcast only after it has
      *measured* the small side against ``autoBroadcastJoinThreshold``).
    * UTC session time zone (the oracle engine is UTC-naive).
    * Spark UI off: no listening server.
    """
    parts = shuffle_partitions or (8 if cpus == "*" else max(2, int(cpus)))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRADELENS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the submitter sets it to a shared file system path and we use
    it unchanged.  Only when it is unset on a local master (tests) do we create
    one; a cluster without it is an error, as its executors share no folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="gradelens-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df, name: str | None = None, compression: str = "snappy"):
    """Materialise ``df`` as a Parquet table under the shared checkpoint folder.

    Survives executor loss (never ``localCheckpoint``) and, unlike an RDD
    checkpoint, later passes read it with column pruning, filter pushdown and
    size statistics.
    """
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name or uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``gradelens`` importable in Python workers (once per SparkContext).

    Code that runs Python inside tasks (pandas UDFs, ``mapInPandas``) pickles
    references to this package's functions; executors import them from the
    zip that ``addPyFile`` distributes with the job.
    """
    import shutil
    sc = spark.sparkContext
    key = sc.applicationId
    with _SHIPPING:
        if key in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        out = tempfile.mkdtemp(prefix="gradelens-pkg-")
        archive = shutil.make_archive(os.path.join(out, "gradelens"), "zip", os.path.dirname(pkg), "gradelens")
        sc.addPyFile(archive)
        _SHIPPED.add(key)


MB = 1 << 20


def scale_conf(input_bytes: int, total_cores: int, split_bytes: int = 256 * MB,
               max_shuffle_partitions: int = 100_000) -> dict[str, str]:
    """Session settings sized for the input: every task handles ~``split_bytes``.

    * scans: ``maxPartitionBytes`` = split size, so a 100 TB input becomes
      ~400k scan tasks of 256 MB;
    * shuffles: one partition per split of input (at least 2 per core, at most
      ``max_shuffle_partitions``); AQE then coalesces partitions that the
      projections and partial aggregations made small, and splits skewed
      join partitions (> 5x the median and > 4 splits);
    * broadcast joins only for sides Spark measures under 64 MB.
    """
    parts = max(2 * total_cores, min(max_shuffle_partitions, -(-input_bytes // split_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * split_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * MB),
    }


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the files under ``paths`` (through the cluster's file system)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return total


def apply_scale_conf(spark: SparkSession, paths: list[str], total_cores: int | None = None) -> dict[str, str]:
    """Size the session for the tables under ``paths`` (runtime SQL settings only)."""
    cores = total_cores or spark.sparkContext.defaultParallelism
    conf = scale_conf(input_bytes(spark, paths), cores)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
