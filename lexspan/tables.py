"""Written tables in the folder that driver and executors share, and rankings and joins that no key can crowd.

The folder is the session's ``spark.checkpoint.dir``; where that is unset, a
session with master ``local`` gets a folder of its own, and on a cluster it is
an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 64
SMALL = 200_000  # rows of a side that may be told to all tasks
PIECE = 1 << 20  # bytes of a piece of an Arrow batch, or one row
SORTED = 1_000_000  # rows that a task should sort at most


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexspan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lexspan/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written once and read back; lost executors lose none of it."""
    return saved(df, shared_folder(df.sparkSession, tag))


def pieces(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about PIECE bytes, so that Python objects are made of few rows at a time."""
    for batch in batches:
        rows = max(1, batch.num_rows * (size or PIECE) // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def small_side(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a hint to tell it to all tasks, if it has at most so many rows; otherwise as it is. df is counted, so it should be written."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by a hash of the keys in tasks of about SORTED rows, where the shuffle partitions are too few for that; df is counted, so it should be files."""
    tasks = -(-df.count() // SORTED)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def best(df: DataFrame, keys: list[str], order: list, k: int, spread: str) -> DataFrame:
    """The k first rows of each key with their rank from 1 (long); a key's rows meet by a hash of column ``spread`` first."""
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    some = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("__salt")
    last = Window.partitionBy(*keys).orderBy(*order)
    return some.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= k)


def in_order(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """df, written, with a long column of numbers from 1 in this order, which rows must not tie on; ranges of it are numbered apart and shifted."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    rows = written(spread, "order")
    counts = rows.groupBy("__part").agg(F.count("*").alias("__count"))
    # a row for each partition
    before = counts.withColumn("__before", F.coalesce(F.sum("__count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.withColumn(name, own).join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__count", "__before")
