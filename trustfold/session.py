"""Session helpers.

The library never creates its own cluster settings on a real cluster: it reads
``spark.checkpoint.dir`` from the session and only sets a private one when the
session runs in local mode and nothing was configured (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "trustfold") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and is
    used as is.  Only a local-mode session without a setting gets a fresh
    scratch folder, so unit tests can run.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="trustfold-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path for an intermediate table in the shared checkpoint folder; ``clear_scratch`` removes it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back: like a checkpoint it is the same for every
    reader, and readers take only the columns and row groups that they need. Rows come in any order."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Remove the intermediate tables that this driver has written so far; call it when their results have been read or
    written elsewhere.  Returns how many there were."""
    n = len(_SCRATCH)
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``trustfold`` importable in Python workers (grouped-map and
    mapInPandas functions are pickled by module reference).

    The package is zipped once per driver process and added with
    ``addPyFile``; Spark distributes it to every executor.  On a cluster
    submitted with ``--py-files`` this is a harmless repeat.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil

    pkg_root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = tempfile.mkdtemp(prefix="trustfold-pkg-")
    archive = shutil.make_archive(os.path.join(out, "trustfold"), "zip", root_dir=pkg_root, base_dir="trustfold")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
