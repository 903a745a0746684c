"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that change results; leave sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g", app: str = "tickloom") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix=f"{app}-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for written tables and streaming state.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-machine session may leave
    that unset; it gets a temporary folder. Elsewhere executors would write to disks of their
    own, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tickloom-")


_SCRATCH: dict[str, list[str]] = {}


def scratch_table(df):
    """``df`` written once to the shared folder and read back.

    Used where a small result feeds several later steps: it cuts the lineage, survives the
    loss of executors, and gives the planner the real size, so that a join with it is
    broadcast only when it is small.
    """
    import uuid

    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = [shared_dir(spark)]
    path = f"{_SCRATCH[app][0]}/tickloom-scratch/{app}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
