"""Files that driver and executors share: the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder in the shared one, deleted when Python ends; where spark.checkpoint.dir is unset in a temporary folder if all runs on one machine, as in tests, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # the session is gone; the cluster clears its folder
            pass

    atexit.register(clear)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and reads it back, so that every later use sees the same rows, and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
