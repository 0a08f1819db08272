"""Ranks and first-k rows of groups of any size: no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.shared import stored

_SLICES = 64


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, within the group of ``keys`` by ``order``.

    Rows are sorted by ranges over keys and order together, so a large group lies in several partitions; each row's
    place in its partition is moved by the counts of the group in earlier partitions.
    """
    placed = stored(rows.repartitionByRange(*[F.col(k).asc() for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    # one row per partition and group: a group has at most as many as there are partitions
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_{k}") for k in keys], before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    out = placed.withColumn("_local", local).join(offsets, same)
    return out.select(*rows.columns, (F.col("_local") + F.col("_before")).cast("int").alias(name))


def first_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their place: the first of hashed slices, then the first of those."""
    cut = Window.partitionBy(*keys, F.pmod(F.xxhash64(*rows.columns), F.lit(_SLICES))).orderBy(*order)
    some = rows.withColumn(name, F.row_number().over(cut)).where(F.col(name) <= k).drop(name)
    return some.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
