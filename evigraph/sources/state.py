"""Where intermediate state may go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; only a local session that has none gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    given = sc.getConf().get("spark.checkpoint.dir")
    if not given and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="evigraph-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share, which nothing else uses."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back; with a folder df is added to what that holds, and all of it
    is read. It is deleted when the driver's JVM ends, or by drop().

    Unlike a checkpoint it forgets the plan's size estimate: the planner knows the size of the files. A checkpoint carries the
    estimate on, for a join the product of both sides, and a loop of joins doubles its digits round by round. A column of type
    void comes back as text.
    """
    spark = df.sparkSession
    path = folder or new_folder(spark, "kept")
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.mode("append").parquet(path)
    file, conf = _file(spark, path)
    file.getFileSystem(conf).deleteOnExit(file)  # must exist by then
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of keep() that no later plan reads."""
    file, conf = _file(spark, folder)
    file.getFileSystem(conf).delete(file, True)


def _file(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
