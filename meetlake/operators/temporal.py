"""Leakage-safe yearly history features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.schema import HISTORY_FEATURES, PRODUCTION_FEATURES, require_columns


def athlete_year(results: DataFrame, athlete: str = "resolved_athlete_id") -> DataFrame:
    """One row per athlete and year. Rows without athlete or year belong to no group and drop out."""
    require_columns(results, (athlete, "year", "total", "best_squat", "best_bench", "best_deadlift", "bodyweight"))
    return (results.where(F.col(athlete).isNotNull() & F.col("year").isNotNull()).groupBy(athlete, "year").agg(
        F.avg("total").alias("year_total_mean"), F.max("total").alias("year_total_max"),
        F.min("total").alias("year_total_min"), F.max("best_squat").alias("year_best_squat"),
        F.max("best_bench").alias("year_best_bench"), F.max("best_deadlift").alias("year_best_deadlift"),
        F.avg("bodyweight").alias("year_bodyweight_mean")))


def temporal_features(years: DataFrame, athlete: str = "resolved_athlete_id") -> DataFrame:
    """Features of each athlete-year from strictly earlier years.

    A window group is one athlete's years, a handful of rows however many results the athlete filed.
    """
    line = Window.partitionBy(athlete).orderBy("year")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    last = {
        "previous_year": "year", "previous_total": "year_total_mean", "previous_squat": "year_best_squat",
        "previous_bench": "year_best_bench", "previous_deadlift": "year_best_deadlift",
        "previous_bodyweight": "year_bodyweight_mean",
    }
    running = {
        "historical_mean_total": F.avg("year_total_mean"), "historical_max_total": F.max("year_total_max"),
        "historical_min_total": F.min("year_total_min"), "historical_std_total": F.stddev_samp("year_total_mean"),
        "historical_max_squat": F.max("year_best_squat"), "historical_max_bench": F.max("year_best_bench"),
        "historical_max_deadlift": F.max("year_best_deadlift"),
        "historical_mean_bodyweight": F.avg("year_bodyweight_mean"),
    }
    seen = years.select(
        "*", *[F.lag(c, 1).over(line).alias(n) for n, c in last.items()],
        F.lag("year_total_mean", 2).over(line).alias("previous_previous_total"),
        (F.row_number().over(line) - 1).alias("previous_year_count"),
        *[c.over(before).alias(n) for n, c in running.items()])
    change = F.col("previous_total") - F.col("previous_previous_total")
    return seen.select(
        "*", (F.col("year") - F.col("previous_year")).alias("years_since_previous"),
        change.alias("previous_total_change"),
        (F.try_divide(change, F.col("previous_previous_total")) * 100).alias("previous_total_change_pct"))


def temporal_dataset(results: DataFrame, athlete: str = "resolved_athlete_id") -> DataFrame:
    """Every result with its athlete-year's history; the right side is unique by construction."""
    lookup = temporal_features(athlete_year(results, athlete), athlete).select(athlete, "year", *HISTORY_FEATURES)
    return results.join(lookup, [athlete, "year"], "left")


def supervised_dataset(results: DataFrame, athlete: str = "resolved_athlete_id") -> DataFrame:
    """Results that have at least one earlier year behind them."""
    return temporal_dataset(results, athlete).where("previous_year_count >= 1")


def production_features(temporal: DataFrame) -> DataFrame:
    """The 22 model features in contract order."""
    return require_columns(temporal, PRODUCTION_FEATURES).select(*PRODUCTION_FEATURES)


def chronology_check(temporal: DataFrame) -> DataFrame:
    """Counters that must all be zero: history from the same or a later year, maxima below the last value."""
    broken = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    c = F.col
    return temporal.agg(
        F.count(F.lit(1)).alias("rows"),
        broken(c("previous_year") >= c("year")).alias("previous_not_before"),
        broken(c("years_since_previous") <= 0).alias("gap_not_positive"),
        broken(c("historical_max_squat") < c("previous_squat")).alias("squat_max_below_previous"),
        broken(c("historical_max_bench") < c("previous_bench")).alias("bench_max_below_previous"),
        broken(c("historical_max_deadlift") < c("previous_deadlift")).alias("deadlift_max_below_previous"),
        broken(c("historical_max_total") < c("historical_min_total")).alias("max_below_min"),
        broken((c("previous_year_count") == 0) & c("previous_total").isNotNull()).alias("history_without_years"))
