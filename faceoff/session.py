"""Session settings and the few helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str | None = None, app: str = "faceoff", **extra: str) -> SparkSession:
    """A UTC, adaptive session.

    Master, memory and the number of shuffle partitions are the deployment's (spark-submit or its defaults);
    ``cores`` asks for a local session of so many threads, as tests and the benchmark do.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "12g")
        if cores != "*":
            builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise ValueError when a contract column is absent; return the frame unchanged."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a scratch one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def write_and_reread(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Cut the lineage through a parquet table in the shared folder, which survives executor loss.

    ``by`` names a column with few values to lay the files out by, so that a filter on it reads only its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Change time and bytes of a file or of the files in a folder, by the store's own listing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = store.listStatus(place)
    return max((f.getModificationTime() for f in files), default=0), sum(f.getLen() for f in files)
