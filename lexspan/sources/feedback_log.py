"""A log of feedback records that a stream writes exactly once.

Each batch of the stream is one partition, named by the batch's number; a batch
that comes again after a failure overwrites its own partition, so replays
change nothing. Reading takes the last record of each id, by batch and then by
the given order. Compaction writes that state as a base up to a batch, which
readers use once it is complete; batches that it covers are then deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeedbackLog:
    """Below path: batches/batch=N and base/upto=N. Records have an id and an order that settles which of a batch is last."""

    path: str
    id_col: str = "record_id"
    order: tuple[str, ...] = ("created_at",)

    def _files(self, spark: SparkSession, name: str):
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return fs, [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last of each id: a maximum that is taken in part before the shuffle."""
        columns = [c for c in rows.columns if c not in (self.id_col, "batch")]
        newest = F.max(F.struct("batch", *self.order, *[c for c in columns if c not in self.order])).alias("x")
        return rows.groupBy(self.id_col).agg(newest).select(self.id_col, *[F.col(f"x.{c}").alias(c) for c in ("batch", *columns)])

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Write a batch as its own partition; for ``foreachBatch``. Records without an id are left out."""
        rows = self._last(batch.where(F.col(self.id_col).isNotNull()).withColumn("batch", F.lit(batch_id).cast("long")))
        # each batch has a folder, which is replaced as a whole
        rows.drop("batch").write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")

    def base(self, spark: SparkSession) -> int:
        """The last batch of the newest complete base; -1 without one."""
        fs, folders = self._files(spark, "base")
        jvm = spark.sparkContext._jvm
        done = [int(p.getName().split("=")[1]) for p in folders if p.getName().startswith("upto=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(done, default=-1)

    def batches(self, spark: SparkSession) -> list[int]:
        """Complete batches, ascending."""
        fs, folders = self._files(spark, "batches")
        jvm = spark.sparkContext._jvm
        return sorted(int(p.getName().split("=")[1]) for p in folders if p.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def current(self, spark: SparkSession) -> DataFrame | None:
        """The last record of each id, with the batch that it came in; None before the first batch."""
        upto = self.base(spark)
        some = [n for n in self.batches(spark) if n > upto]
        parts = []
        if upto >= 0:
            parts.append(spark.read.parquet(f"{self.path}/base/upto={upto}"))
        if some:
            root = f"{self.path}/batches"
            parts.append(spark.read.option("basePath", root).parquet(*[f"{root}/batch={n}" for n in some]).withColumn("batch", F.col("batch").cast("long")))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self._last(rows) if some else rows

    def compact(self, spark: SparkSession, keep: int = 0) -> int:
        """Write a base up to the last complete batch and delete what it covers but the last ``keep`` batches; its number, or -1.

        A batch that is replayed after its compaction has a number that the
        base covers, so readers pass it over.
        """
        upto, there = self.base(spark), self.batches(spark)
        last = max([upto, *there])
        if last > upto:
            self.current(spark).write.mode("overwrite").parquet(f"{self.path}/base/upto={last}")
        fs, folders = self._files(spark, "batches")
        for p in folders:
            if int(p.getName().split("=")[1]) <= last - keep:
                fs.delete(p, True)
        fs, folders = self._files(spark, "base")
        for p in folders:
            if int(p.getName().split("=")[1]) < last:
                fs.delete(p, True)
        return last

    def follow(self, records: DataFrame, checkpoint: str):
        """Start a query that merges a stream of records and ends when all that is there has been read."""
        return records.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
