"""Row numbers and latest rows without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.sources.scratch import materialise


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with the global row number in ``order``: ranges are sorted apart and start where those before end."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number's top bits are the partition, its low 33 bits the row; written, as ranges are sampled anew in each run.
    placed = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so this window is small.
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_first")
    row = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1) + start
    return placed.join(F.broadcast(first), "_part").withColumn(name, row).drop("_at", "_part", "_first")


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, keys: list[str], at: str, cutoff, tie: str) -> DataFrame:
    """The latest row per key not after ``cutoff``."""
    return first_per(df.where(F.col(at) <= cutoff), keys, [F.col(at).desc(), F.col(tie).desc()])


def top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)
