"""Session construction and the shared checkpoint folder.

Library code never invents a checkpoint location: it reads ``spark.checkpoint.dir``
from the session (the cluster names a shared folder there).  Only when that setting
is absent -- local tests, the bench -- is a fresh scratch folder created.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: adaptive execution re-plans joins and partition
# counts from runtime statistics; skew-join splitting handles hot keys.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "clinloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _active_dir(spark: SparkSession) -> str | None:
    return spark.sparkContext.getCheckpointDir()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The checkpoint folder in use, else the one the session's configuration names."""
    return _active_dir(spark) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) \
        or spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder ``checkpoint()`` writes to.

    Keeps a folder already in use; otherwise uses ``spark.checkpoint.dir`` from the
    session (the cluster's shared folder); only when neither exists (local tests) a
    fresh scratch folder is created.
    """
    active = _active_dir(spark)
    if active is not None:
        return active
    configured = checkpoint_dir(spark)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(checkpoints and round-trip writes go there)")
        configured = tempfile.mkdtemp(prefix="clinloom-ckpt-")   # local runs and tests only
    spark.sparkContext.setCheckpointDir(configured)
    return _active_dir(spark) or configured


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can read; unlike an RDD checkpoint the
    readers keep column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: dict[str, bool] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Tasks import their functions from it, wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if not _shipped.get(app):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="clinloom-src-")        # read by the driver only, which serves the file
        shutil.copytree(os.path.join(root, "clinloom"), os.path.join(folder, "src", "clinloom"),
                        ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "clinloom"), "zip",
                                                         os.path.join(folder, "src")))
        _shipped[app] = True


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for a job reading ``input_bytes`` on ``total_cores`` cores.

    * scan splits of ``target_partition_bytes`` (``spark.sql.files.maxPartitionBytes``);
    * the initial shuffle partition count sized so that each reducer receives about one
      target partition of the input, never fewer than 3 tasks per core; adaptive
      execution then coalesces small partitions and splits skewed ones;
    * advisory and skew thresholds at the same size, so a reducer's input fits
      comfortably in an executor's execution memory and spills stay rare.
    """
    parts = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    size = f"{target_partition_bytes // (1 << 20)}m"
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    }
