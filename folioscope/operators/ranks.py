"""Ranks inside groups of any size, without a task that takes a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.sources.tables import kept


def ranked(rows: DataFrame, group: list[str], order: list[str], rank: str = "k") -> DataFrame:
    """rows with their place in the group, from 1, in order of `order`; rows alike in it may swap places.

    Rows are dealt by range of group and order, which parts a group of any size; a rank is the place inside the part plus the
    sizes of the group's parts before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = placed.withColumn(rank, F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order)))
    # nulls are a group, too
    on = [inside["_part"] == offsets["_part"], *[inside[c].eqNullSafe(offsets[c]) for c in group]]
    return inside.join(offsets, on).select(*[inside[c] for c in rows.columns], (inside[rank] + offsets["_before"]).alias(rank))
