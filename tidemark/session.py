"""The Spark session that tests, bench and the entry point share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_see_package() -> None:
    """Put the repository on PYTHONPATH, so that Python workers started later can import it."""
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    workers_see_package()
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir. Where that is unset and the session is local, as in tests, a temporary folder is set; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read from there: what several branches read is computed once and survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str, rows_a_task: int = 100_000) -> DataFrame:
    """df in tasks by keys, as many as rows (a count known before) need of so many each, so that what a task holds doesn't grow with the table. Windows, aggregations and joins by keys that include these go on in the same tasks."""
    return df.repartition(max(1, -(-rows // rows_a_task)), *keys)
