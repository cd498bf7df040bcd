"""Loading of tables and settings shared by every query."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; nothing is read before an action."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the session names it in spark.checkpoint.dir.

    Where the setting is absent and the session runs on this machine alone, a temporary folder is made and set; on a
    cluster its absence is an error, since no machine's own folder is shared.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not conf:
        conf = "file://" + tempfile.mkdtemp(prefix=f"docloom-{os.getpid()}-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(conf)
    return conf


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed with all below it when the program ends."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again; for results too wide for a checkpoint,
    whose files are not compressed."""
    path = scratch_path(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session may be gone already
            return
