"""Tables between the rounds of iterative plans, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may leave it unset and then gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cloakframe-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df and reads it back, so that later plans do not repeat what made it."""
    names = df.columns
    path = f"{shared_dir(df.sparkSession)}/cloakframe-{label}-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"x{i}" for i in range(len(names))])  # any name may stand in a table
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*names)


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cloakframe-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dense_index(df: DataFrame, to: str, *order: str) -> DataFrame:
    """df with a column `to`: 0, 1, 2, ... in the order of the columns, which must be unique together.

    A range sort numbers the rows of each partition; the counts of the partitions, one row each, give the offsets.
    """
    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(sorted_rows.withColumn("_cf_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_cf_id", 33)
    offsets, total = [], 0
    for r in numbered.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], total))
        total += r["count"]
    side = spark.createDataFrame(offsets, "part long, before long")
    row = F.col("_cf_id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(side), part == F.col("part")).withColumn(to, F.col("before") + row).drop("part", "before", "_cf_id")
