"""Running sums over a whole table without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_sum(df: DataFrame, value: str, order: str, out: str, by: tuple[str, ...] = (), width: int = 4096) -> DataFrame:
    """Column ``out``: the sum of ``value`` over the rows before each one in the order of the integer column ``order``.

    Rows are cut into buckets of ``width`` consecutive order values; sums inside a bucket and sums of whole buckets are two
    windows, of which only the second, with a row per bucket, runs over all of a ``by`` group.  Null sums count as 0.
    """
    cut = df.withColumn("__bucket", F.floor(F.col(order) / width).cast("long"))
    keys = [*by, "__bucket"]
    sums = cut.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    before = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    summed = cut.withColumn("__inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = summed.join(offsets, match).drop(*(f"__k{i}" for i in range(len(keys))))
    return joined.withColumn(out, (F.col("__offset") + F.col("__inner"))).drop("__bucket", "__offset", "__inner")
