"""Lineage cuts and size-checked joins.

Every cut is a Parquet table below the folder that the cluster names in ``spark.checkpoint.dir``; driver and executors
share it, so losing an executor loses nothing.  Only where the setting is absent (tests, local runs) a local folder is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where cuts go when the session names no shared folder.
LOCAL_DIR = "file:///tmp/checkpoints"
#: Rows of a side that may be broadcast; checked by counting before every broadcast.
BROADCAST_ROWS = 400_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a cluster has to name one, as its nodes do not share local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL_DIR
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tesserae-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised side for broadcast if it has at most ``limit`` rows; otherwise leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def keep_ids(docs: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join of wide rows with an id table; wide rows are shuffled only if the ids pass the broadcast bound."""
    return docs.join(small_side(materialise(ids.select(on).distinct())), on, how)


def split_join(rows: DataFrame, counted: DataFrame, on: str, count: str, total: int, share: int = 4000) -> DataFrame:
    """Inner join of ``rows`` with ``counted`` (one row per key, materialised) that no hot key can unbalance.

    A key with more than ``total / share`` rows is hot; there are fewer than ``share`` of those by counting, so that side
    is broadcast.  All other keys are joined by a shuffle in which each has at most ``total / share`` rows.
    """
    bound = max(1, total // share)
    hot, cold = counted.where(F.col(count) > bound), counted.where(F.col(count) <= bound)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(cold.hint("merge"), on))


def hash_sample(df: DataFrame, hash_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows, those with the smallest values of a 64-bit hash column; all rows where there are no more.

    A bound on the hash is chosen from the count, so nothing is sorted and no partition sends more than its share.
    """
    n = df.count()
    return df if n <= rows else df.where(F.pmod(hash_col, F.lit(1 << 40)) < int((1 << 40) * rows / n))
