"""Spark session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Session settings used by tests and the benchmark.  On a cluster the cluster's
# own defaults win for anything already set.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # a round's checkpoint goes when nothing refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Higher-order functions over lattice edges are interpreted per row; keep
    # file splits moderate so a task's rows fit comfortably in memory.
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "corpuskit",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session with
    nothing configured (tests) gets a scratch folder of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpuskit-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return sc.getCheckpointDir()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their
    Python workers can import the kernels whatever their working folder is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="corpuskit-"), "corpuskit.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable: survives
    the loss of executors) and return a DataFrame that reads it back."""
    ensure_checkpoint_dir(df.sparkSession)
    # persist first: a reliable checkpoint otherwise recomputes the plan in a
    # second job to write the files
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


#: How the names of the folders begin that ``stored`` makes.
STORED = "table-"


def stored(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, for large tables that are not replaced round by round: a
    Parquet table in the shared checkpoint folder, compressed and read by columns.
    How its rows were dealt and ordered is not kept."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{STORED}{uuid.uuid4().hex}"
    # the rows that were shuffled to make the table are not kept beside it
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if kept is None else spark.conf.set(key, kept)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the folders of ``stored`` that these tables read: nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        root = ensure_checkpoint_dir(spark)
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if os.path.basename(folder).startswith(STORED) and os.path.basename(os.path.dirname(folder)) == os.path.basename(root):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the session's cores when the scan yields fewer
    splits than that (e.g. one file with one row group).  A corpus of many
    files already has enough splits and is left alone: no extra shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(table_path(sf_dir, name)))
