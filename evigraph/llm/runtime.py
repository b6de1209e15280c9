"""Where intermediate tables go, and small helpers that every operator here shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

_OWN: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch.
BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that has none gets a temporary folder; a cluster without the setting is refused, as a
    machine-local folder would not be seen by the other executors.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="evigraph-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts lineage and survives lost executors.

    The tasks are those of df's own plan: splits of a scan, or partitions that the adaptive planner has sized.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialize() made and that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
            parent.getFileSystem(conf).delete(parent, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a few MB at a time: unless the session sets it itself, its bytes in an Arrow batch are lowered."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus: the fold a labelled row belongs to."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def space_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+")
    return F.array_remove(parts, "")
