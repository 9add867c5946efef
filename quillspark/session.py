"""Session set-up that queries need."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return context.getCheckpointDir().get()


def attach(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver did (on a cluster, ship it with --py-files)."""
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "")
    if ROOT not in held.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (held, ROOT) if x)
    return spark


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of ours; nothing happens if it, or the session, is gone."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Exception:  # noqa: BLE001
        pass


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and returns it read back: cuts lineage and survives lost executors.

    A path (of scratch) is given by who removes it before the driver ends.
    """
    path = path or scratch(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
