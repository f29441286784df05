"""Exact duplicate results on the 21-field key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.schema import RESULT_KEY


def duplicate_groups(results: DataFrame, key: Sequence[str] = RESULT_KEY, order: str = "seq") -> DataFrame:
    """One row per key filed more than once, with its size and first and last filing."""
    return results.groupBy(*key).agg(
        F.count(F.lit(1)).alias("records"), F.min(order).alias("first_record"),
        F.max(order).alias("last_record")).where("records > 1")


def duplicate_members(results: DataFrame, key: Sequence[str] = RESULT_KEY, order: str = "seq") -> DataFrame:
    """Every row of every duplicate group, tagged with the group's first filing."""
    groups = duplicate_groups(results, key, order).select(*[F.col(k).alias(f"g_{k}") for k in key], "first_record")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"g_{k}"))
    return results.join(groups, same).select(*results.columns, "first_record")


def duplicate_report(results: DataFrame, key: Sequence[str] = RESULT_KEY) -> DataFrame:
    sizes = results.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.count(F.lit(1)).alias("unique_records"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_records"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"))


def deduplicate(results: DataFrame, key: Sequence[str] = RESULT_KEY, order: str = "seq") -> DataFrame:
    """Keep the first filing of every key.

    The rank-one filter is applied before the shuffle as well, so a key filed millions of times sends
    one row per task.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return results.withColumn("_rank", place).where("_rank = 1").drop("_rank")
