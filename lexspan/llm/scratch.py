"""Written intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset a
folder is made for a session with master ``local`` (tests, notebooks); on a
cluster an unset folder is an error, as no local one is shared. A written table cuts the
lineage and survives lost executors, because its files belong to no executor.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of this application's own folder below the shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexspan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lexspan/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def mounted_folder(spark: SparkSession, tag: str) -> str:
    """A new shared folder as a path that workers can open themselves.

    Files that are memory-mapped or range-read need the shared folder mounted
    on every worker; a folder that only Spark can reach is refused here, with
    a plain message, rather than failing in a task.
    """
    uri = urlparse(new_folder(spark, tag))
    if uri.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a folder mounted on all workers, not {uri.scheme}://")
    return uri.path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, tag: str) -> None:
    """Delete this application's shared folders whose tag starts so."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(root):
        for status in fs.listStatus(root):
            if status.getPath().getName().startswith(tag):
                fs.delete(status.getPath(), True)


def fresh(taken, *names: str) -> list[str]:
    """Column names like names that no column in taken has (case ignored)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
