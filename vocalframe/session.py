"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # map_concat overlays (J7/T13) keep the right-hand value for a repeated key
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "vocalframe", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes.

    On a cluster the submitter owns master, memory and partition counts; locally
    we default to ``local[*]`` with a shuffle width equal to the core count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:  # local mode: the driver JVM is also the executor
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable library settings to an existing session."""
    for k, v in _LOCAL_CONF.items():
        if k.startswith("spark.ui") or k.startswith("spark.sql.execution.arrow"):
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave as configured
            pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it; a missing setting is an error there. Only a local master may
    leave it unset, and then gets a fresh folder of its own.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="vocalframe-ckpt-")
    sc.setCheckpointDir(local)
    try:  # core configs may be read-only at run time; the context already has it
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # noqa: BLE001
        pass
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and reread: its consumers
    read the same rows, and a lost executor costs a re-read."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition by ``keys`` only when the input is narrower than the cluster.

    Single-file inputs arrive as one partition; wide inputs (thousands of files)
    already give every core work, and an extra shuffle would only cost I/O.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    # a few partitions per core even out rows of very different cost
    target = 4 * cores
    return df.repartition(target, *keys) if keys else df.repartition(target)
