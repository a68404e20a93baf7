"""Sources and sinks: string-keyed CSV, compact memberships, resumable run tables."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.version import __version__ as SPARK_VERSION

MEMBERSHIP = T.StructType([T.StructField("run", T.StringType()), T.StructField("unit", T.LongType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header under a stated schema, so that ids stay strings."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, nulls empty; the committer makes it whole or absent."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def membership_long(compact: DataFrame) -> DataFrame:
    """(run, unit, cluster, weight) from one array of weights a unit, units first."""
    return compact.select("run", "unit", F.posexplode("weights").alias("cluster", "weight")).withColumn("cluster", F.col("cluster") + 1)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """All membership files of a folder; without files an empty table of the same schema."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(found) or not any(s.getPath().getName().endswith(".parquet") for s in store.listStatus(found)):
        return spark.createDataFrame([], MEMBERSHIP)
    return spark.read.schema(MEMBERSHIP).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path that driver and executors share, deleted when the driver ends: under spark.checkpoint.dir, or, where
    that is unset, under a temporary folder on local masters and the warehouse elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = "file://" + tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    home = f"{root.rstrip('/')}/terrane-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    atexit.register(lambda: spark.sparkContext._jsc is not None and at.getFileSystem(conf).delete(at, True))
    return f"{home}/{name}"


def fingerprint(config: dict, code: str = "") -> str:
    """MD5 of the configuration, the code that makes the tables, and Spark's version."""
    return hashlib.md5((json.dumps(config, sort_keys=True) + code + SPARK_VERSION).encode()).hexdigest()


class Study:
    """A folder of run tables. Opening it with another configuration or other code is an error."""

    def __init__(self, spark: SparkSession, path: str, config: dict, resume: bool = True, code: str = "") -> None:
        self.spark, self.path = spark, path.rstrip("/")
        mark = fingerprint(config, code)
        manifest = f"{self.path}/manifest"
        if not self._there("manifest"):
            row = spark.createDataFrame([(mark, json.dumps(config, sort_keys=True))], "fingerprint string, config string")
            row.write.mode("errorifexists").parquet(manifest)
        elif not resume:
            raise ValueError("the study exists")
        elif spark.read.parquet(manifest).first()["fingerprint"] != mark:
            raise ValueError("the study was made with another configuration")

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _there(self, name: str) -> bool:
        store, at = self._at(name)
        return store.exists(at)

    def pending(self, expected: DataFrame) -> DataFrame:
        """Expected runs (run_id, ...) that have no result yet."""
        if not self._there("result"):
            return expected
        return expected.join(self.report("result").select("run_id").distinct(), "run_id", "left_anti")

    def save(self, run_id: str, table: str, df: DataFrame) -> None:
        """A run's rows of a table, in a folder of their own: a run done again replaces its rows."""
        own = hashlib.md5(run_id.encode()).hexdigest()
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{self.path}/{table}/run=_{own}")

    def report(self, table: str) -> DataFrame:
        """All runs' rows of a table, columns united."""
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{table}").drop("run")

    def tables(self) -> list[str]:
        store, at = self._at("")
        return sorted(f.getPath().getName() for f in store.listStatus(at) if f.isDirectory() and f.getPath().getName() != "manifest")

    def write_reports(self, out: str) -> list[str]:
        """One CSV a table, of all runs; the tables' names."""
        for table in self.tables():
            write_csv(self.report(table), f"{out}/{table}")
        return self.tables()
