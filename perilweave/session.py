"""Session helpers: a local session for tests and a durable lineage cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: str = "*", partitions: int = 8, name: str = "perilweave", shared: str | None = None,
    memory: str = "4g",
) -> SparkSession:
    """A small single-machine session for tests and benchmarks; ``shared`` is its folder for stages."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folders of local sessions that name none; the setting itself is fixed once a session runs.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local master may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _own_dirs:
        _own_dirs[application] = tempfile.mkdtemp(prefix="spark-perilweave-")
    return _own_dirs[application]


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back.

    Cuts the lineage durably, so a lost executor costs a re-read and not a
    re-run, and keeps column pruning for the several readers that follow.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/perilweave/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
