"""Where intermediate tables live, and how worker processes find this package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


#: Settings by which worker processes hand freed large blocks back to the system.
HAND_BACK = {"MALLOC_TRIM_THRESHOLD_": "4194304", "MALLOC_MMAP_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs in one process, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if found := spark.sparkContext.getCheckpointDir():
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="terrafold-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    folder = f"file://{own}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def workers(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from any working directory, and hand them whole texts
    in batches of at most 2000 rows, so that a batch of long texts stays small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    env = spark.sparkContext.environment
    for name, value in HAND_BACK.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh(spark, name)
    writer = df.write.option("compression", "lz4")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
