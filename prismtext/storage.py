"""Tables in the folder that driver and executors share: intermediate results, batches that are written once, and row numbers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where a local session leaves it unset, a folder below the warehouse."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/prismtext-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: worked out once, and not again if an executor is lost."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[str]:
    """The names of a table's whole batches. A batch that was broken off has no mark of success and counts for nothing."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [x.getPath().getName() for x in files.listStatus(folder) if x.isDirectory()]
    return sorted(n for n in names if files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0]))


def read_batches(spark: SparkSession, path: str, schema: str | StructType, only: Sequence[str] | None = None) -> DataFrame:
    """All whole batches of a table, or those of ``only``; no rows where there is none yet."""
    names = [n for n in committed(spark, path) if only is None or n in only]
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """Write one batch, with its name as the column batch; what a broken run left of it goes."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/{batch}")


def numbered(df: DataFrame, keys: Sequence[Column], name: str = "number", weight: Column | None = None) -> DataFrame:
    """``df`` with the number (from 0) of each row in order of ``keys``, or the sum of the weights before it.

    Ranges of the keys are sorted apart, a task each, however many rows a key
    has; only the ranges' sums, a row for each task, are added up in one place.
    """
    weight = F.lit(1) if weight is None else weight
    own, part, place, ahead = (f"_{name}_{x}" for x in ("weight", "part", "place", "ahead"))
    dealt = df.withColumn(own, weight.cast("long")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Higher bits: the task; lower ones: the place in it.
    rows = stored(dealt.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)), "numbered")
    sums = rows.groupBy(part).agg(F.sum(own).alias(ahead))
    before = sums.select(part, (F.sum(ahead).over(W.orderBy(part)) - F.col(ahead)).alias(ahead))
    inside = F.sum(own).over(W.partitionBy(part).orderBy(place)) - F.col(own)
    return rows.withColumn(name, inside).join(before, part).withColumn(name, F.col(name) + F.col(ahead)).drop(own, part, place, ahead)
