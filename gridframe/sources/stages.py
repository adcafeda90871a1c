"""Stage tables: intermediate relations written to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir; a temporary one is made only on a
    local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gridframe-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: With it, the shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Stage tables that were written and not removed yet.
_paths: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table that is written once: its plan is short from there, and a lost executor costs nothing before
    it.  (A Dataset checkpoint would compute it twice.)  What was shuffled for it goes.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    _paths.append(path)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many stage tables there are: those written since then can be removed when nothing reads them any more."""
    return len(_paths)


def remove(spark: SparkSession, begin: int = 0) -> None:
    """Removes the stage tables from mark ``begin`` on, wherever the shared folder is."""
    for path in _paths[begin:]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    del _paths[begin:]
