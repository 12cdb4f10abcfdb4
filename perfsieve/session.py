"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "perfsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; every setting can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def setting(spark: SparkSession, name: str, default: int) -> int:
    """An integer tuning value, read from the session so that a cluster or a test can set it."""
    return int(spark.conf.get(f"perfsieve.{name}", str(default)))


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    All folders of a run lie in one, which ``remove_work`` deletes. Without the setting only a local
    session runs: it works below its warehouse folder and tidies up when the process ends.
    """
    return f"{_run_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


_TIDIED: set[str] = set()


def _run_folder(spark: SparkSession) -> str:
    name = f"perfsieve-{spark.sparkContext.applicationId}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work/{name}"
    if folder not in _TIDIED:
        _TIDIED.add(folder)
        atexit.register(shutil.rmtree, unquote(urlparse(folder).path), ignore_errors=True)
    return folder


def remove_work(spark: SparkSession) -> None:
    """Delete what this run has written to the shared folder; frames that read from it are lost."""
    remove_folder(spark, _run_folder(spark))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no frame in use reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared work folder and read back.

    Used where several later steps (a size check, a sketch, both sides of a join) need the same
    result: none of them recomputes it, and a lost executor costs only the tasks it was running.
    """
    return materialize_at(df, work_folder(df.sparkSession, purpose))


def materialize_at(df: DataFrame, path: str) -> DataFrame:
    """``materialize`` to a folder that the caller names, and may remove."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int = 64) -> DataFrame:
    """Rows of a scan with few splits (one small file, say) dealt out to more tasks.

    For expensive row-wise work on small inputs. A scan that already has a split per core, as any
    large table has, is returned unchanged.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, most)
    return df if df.rdd.getNumPartitions() * 2 > wanted else df.repartition(wanted)
