"""Session plumbing shared by the operators: batch sizes and the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from terrane.functions.ship import ship

#: Rows and bytes in an Arrow batch at most. Texts may be long, so bytes decide.
BATCH_ROWS, BATCH_BYTES = 10_000, 2 << 20

_OWN: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that long texts don't add up in memory; and the package on the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and one of
    our own only where the session names none (a temp folder on local masters, the
    warehouse elsewhere)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="terrane-")
        else:
            _OWN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_terrane"
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/terrane-{uuid.uuid4().hex}/{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            at = jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(conf).delete(at, True)

    atexit.register(drop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: the lineage ends
    there, and lost executors cost no more than the reading."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
