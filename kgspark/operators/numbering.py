"""Positions, first rows and top rows per group, written so that one huge group does not land in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def positions(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "pos", start: int = 0) -> DataFrame:
    """Number the rows of each group (or of the whole table) in ``order``, from ``start``.

    Rows are range-partitioned on group and order, so a hot group spreads over many partitions; each partition numbers
    its own slice and adds the number of rows that earlier partitions hold for the group. ``order`` should be a total
    order inside the group. The tagged rows are written out because slice borders come from a sample.
    """
    group = group or []
    keys = [F.col(c) for c in group + order]
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tagged = cut_lineage(df.repartitionByRange(parts, *keys).withColumn("_slice", F.spark_partition_id()))
    sizes = tagged.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)  # one row per slice
    offsets = sizes.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(*group, "_slice").orderBy(*order))
    cols = [c for c in df.columns if c != name]
    return tagged.withColumn("_local", local).join(offsets, [*group, "_slice"]).select(
        *cols, (F.col("_before") + F.col("_local") - 1 + start).cast("bigint").alias(name))


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the smallest by ``order``. A plain aggregate, so most rows go away before the shuffle."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    ordered = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order_cols)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordered).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def top_per(df: DataFrame, group: list[str], order: list[Column | str], k: int | None, name: str = "rank") -> DataFrame:
    """The first k rows per group (all without k) with their position from 1. The limit is applied before and after the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    cols = [c for c in df.columns if c != name]
    numbered = df.withColumn("_rn", F.row_number().over(w))
    return (numbered if k is None else numbered.filter(F.col("_rn") <= k)).select(
        *cols, F.col("_rn").alias(name))
