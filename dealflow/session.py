"""Spark session settings for local runs (tests, bench) and the shared checkpoint folder.

On a cluster the session comes from the platform; ``ensure_checkpoint_dir`` only sets a
checkpoint folder when the cluster has not named one in ``spark.checkpoint.dir``.
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every run needs for identical results: dates are taken in UTC (the warehouse's
# DATE(timestamp) semantics) and ANSI stays on so bad casts fail loudly (lenient casts use try_cast).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# PySpark records the call site of every Column it makes, with several round trips to the JVM each;
# a report is made of thousands. Errors then name the expression but not the Python line. Static:
# to be set when the session is made.
DRIVER_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# Scale settings: AQE re-plans joins from runtime sizes (an owner or spine side becomes a
# broadcast only when its measured size is under the threshold), coalesces small shuffle
# partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # Generated methods above 8000 bytes are never JIT-compiled by HotSpot and run
    # interpreted; at this limit Spark splits such stages instead (documented advice).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def cluster_conf(input_bytes: int, executor_cores: int, executors: int,
                 shuffle_partitions: int | None = None) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of deal / event data.

    * Scan splits of 256 MiB: a 100 TB input gives ~400k tasks (several waves per core).
    * Shuffles start at ``shuffle_partitions``, by default one partition per 256 MiB of input
      and one per core at least: the only large shuffles are the per-deal call aggregate and its
      join, which scale with the deals;
      AQE then coalesces the small ones toward 128 MiB and splits skewed ones, so no task
      holds more than its share in memory and sorts spill instead of failing.
    * Broadcasts stay bounded by the 32 MiB threshold (AQE decides from measured sizes)."""
    split = 256 * 1024 * 1024
    return {
        **REQUIRED_CONF, **SCALE_CONF, **DRIVER_CONF,
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle_partitions or max(executor_cores * executors, input_bytes // split)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "dealflow") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("DEALFLOW_DRIVER_MEMORY", "8g"))
               .config("spark.driver.extraJavaOptions",
                       os.environ.get("DEALFLOW_JAVA_OPTS", "-XX:-DontCompileHugeMethods")))
    for k, v in {**REQUIRED_CONF, **SCALE_CONF, **DRIVER_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the one already set on the context, else the cluster's shared
    ``spark.checkpoint.dir``. Where neither is set a single-process session (``local[...]``) gets a
    scratch folder; on a cluster a folder of one machine would lose data, so that fails."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    current = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="dealflow-ckpt-")
    sc.setCheckpointDir(current)
    return current


def written(df):
    """``df`` written once as Parquet in the shared checkpoint folder and read back: the files survive
    lost executors, and readers take only the columns they use."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df):
    """Cut lineage: write ``df`` once to the shared checkpoint folder and read it back
    (a reliable checkpoint survives executor loss; never a node-local cache)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
