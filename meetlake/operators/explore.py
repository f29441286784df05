"""Descriptive tables over the result table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.functions.numbers import total_differs
from meetlake.operators.ordered import exact_percentiles
from meetlake.schema import ATTEMPTS, BESTS

NUMERIC = ("bodyweight", *BESTS, "total")


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def overview(results: DataFrame, athlete: str = "athlete_id") -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("records"), F.lit(len(results.columns)).alias("columns"),
        F.countDistinct(athlete).alias("athletes"), F.countDistinct("competition").alias("competitions"),
        F.countDistinct("year").alias("years"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))


def career_summary(results: DataFrame, athlete: str = "resolved_athlete_id") -> DataFrame:
    """Participation and best values per athlete (rows without an id form their own group)."""
    return results.groupBy(athlete).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("competition").alias("competitions"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        *[F.max(b).alias(b) for b in BESTS], F.max("total").alias("best_total"),
        F.avg("bodyweight").alias("mean_bodyweight")).withColumn(
        "career_span_years", F.col("last_year") - F.col("first_year"))


def frequency_share(results: DataFrame, column: str) -> DataFrame:
    """Value counts with their share of all rows; null is shown as a value of its own."""
    counts = results.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<MISSING>")).alias("value")).agg(
        F.count(F.lit(1)).alias("records"))
    # the total is a scalar subquery over the few distinct values, not a window over them
    whole = counts.agg(F.sum("records")).scalar()
    return counts.withColumn("percent", F.bround(F.col("records") / whole * 100, 2))


def column_profile(results: DataFrame) -> DataFrame:
    """Per column: type, non-null, missing, distinct values and missing share.

    Values are counted per (column, value) first; a constant column costs one row per task.
    """
    types = F.create_map(*[F.lit(x) for pair in results.dtypes for x in pair])
    long = results.select(*[F.col(c).cast("string").alias(c) for c in results.columns]).unpivot(
        [], results.columns, "field", "value")
    sized = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    filled = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
    return sized.groupBy("field").agg(
        filled.alias("non_null"), (F.sum("n") - filled).alias("missing"), F.count("value").alias("unique"),
        F.bround((F.sum("n") - filled) / F.sum("n") * 100, 2).alias("missing_percent")).withColumn(
        "dtype", types[F.col("field")])


def describe(results: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles per column."""
    quarters = exact_percentiles(results, columns, (0.25, 0.5, 0.75)).groupBy("name").pivot(
        "prob", [0.25, 0.5, 0.75]).agg(F.first("value")).toDF("field", "p25", "p50", "p75")
    long = results.select(*columns).unpivot([], list(columns), "field", "value")
    basics = long.groupBy("field").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return basics.join(quarters, "field", "left")


def correlation(results: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are present; null for a constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def pearson(a: str, b: str) -> Column:
        spread = [F.stddev_pop(F.when(F.col(other).isNotNull(), F.col(c))) for c, other in ((a, b), (b, a))]
        return F.try_divide(F.covar_pop(a, b), spread[0] * spread[1])

    wide = results.agg(*[pearson(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{k}").alias("correlation"))
        for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def iqr_outliers(results: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Rows outside 1.5 interquartile ranges per column; missing values are never outliers."""
    quarters = exact_percentiles(results, columns, (0.25, 0.75)).groupBy("name").agg(
        F.min("value").alias("q1"), F.max("value").alias("q3"))
    long = results.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "name", "value")
    span = (F.col("q3") - F.col("q1")) * 1.5
    outside = (F.col("value") < F.col("q1") - span) | (F.col("value") > F.col("q3") + span)
    # one bound pair per listed column
    return long.join(F.broadcast(quarters), "name", "left").groupBy(F.col("name").alias("field")).agg(
        F.count_if(F.coalesce(outside, F.lit(False))).alias("outliers"), F.count(F.lit(1)).alias("rows")).select(
        "field", "outliers", F.bround(F.col("outliers") / F.col("rows") * 100, 2).alias("percent"))


def zero_attempts(results: DataFrame) -> DataFrame:
    """Zero and missing counts per attempt column."""
    long = results.select(*ATTEMPTS).unpivot([], list(ATTEMPTS), "field", "value")
    return long.groupBy("field").agg(F.count_if(F.col("value") == 0).alias("zero_count"),
                                     F.count_if(F.col("value").isNull()).alias("missing_count"))


def has_zero_attempt() -> Column:
    return _any([F.col(a) == 0 for a in ATTEMPTS])


def complete_cases(results: DataFrame, columns: Sequence[str] = (*BESTS, "total")) -> DataFrame:
    """Rows where all listed columns are present."""
    return results.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def total_check(results: DataFrame) -> DataFrame:
    """Rows whose total differs from the sum of bests by more than 0.01, with both values."""
    summed = sum(F.col(b) for b in BESTS)
    return complete_cases(results).where(total_differs((*BESTS, "total"), 0.01)).withColumns({
        "calculated_total": summed, "difference": summed - F.col("total")})


def eda_readiness(results: DataFrame, row_columns: Sequence[str] | None = None) -> DataFrame:
    """Counts of missing required fields, exact duplicate rows and rows with a zero attempt."""
    row = list(row_columns or results.columns)
    need = ("resolved_athlete_id", "competition", "year", "division", "weight_class", "equipment")
    per_row = results.select(*row, has_zero_attempt().cast("int").alias("_zero")).groupBy(*row, "_zero").agg(
        F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    return per_row.agg(
        F.sum(n).alias("records"),
        *[F.coalesce(F.sum(F.when(F.col(c).isNull(), n)), F.lit(0)).alias(f"missing_{c}") for c in need],
        F.sum(n - 1).alias("exact_duplicate_rows"),
        F.sum(n * F.col("_zero")).alias("records_with_zero_attempt"))


def duplicate_keys(results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Identity keys that occur more than once."""
    return results.groupBy(*key).agg(F.count(F.lit(1)).alias("records")).where("records > 1")
