"""Splits, baselines and error reports. Predictions are long: model, target, actual, predicted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.operators.ordered import exact_percentiles, group_percentiles
from meetlake.schema import TARGETS

# fixed values: last training year, last validation year, tolerances of the total check in kg
TRAIN_END, VALIDATION_END = 2022, 2024
GOOD_WITHIN, ACCEPTABLE_WITHIN = 5.0, 15.0


def with_split(rows: DataFrame, train_end: int = TRAIN_END, validation_end: int = VALIDATION_END) -> DataFrame:
    """Chronological split by year."""
    year = F.col("year")
    return rows.withColumn("split", F.when(year <= train_end, "train").when(
        year <= validation_end, "validation").when(year.isNotNull(), "test"))


def split_summary(rows: DataFrame, athlete: str) -> DataFrame:
    per = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct(athlete).alias("athletes"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    whole = per.agg(F.sum("records")).scalar()
    return per.withColumn("percent", F.bround(F.col("records") / whole * 100, 2))


def shared_years(rows: DataFrame) -> DataFrame:
    """Years that occur in more than one split; empty for a sound split."""
    return rows.select("split", "year").distinct().groupBy("year").agg(F.count(F.lit(1)).alias("splits")).where("splits > 1")


def target_stats(rows: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    long = rows.select("split", *targets).unpivot(["split"], list(targets), "target", "value")
    return long.groupBy("split", "target").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def baseline_predictions(rows: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Train mean and previous performance, as predictions of every non-training row.

    ``rows`` needs the split, the targets and the previous_* features.
    """
    last = {"best_squat": "previous_squat", "best_bench": "previous_bench", "best_deadlift": "previous_deadlift",
            "total": "previous_total"}
    train = rows.where("split = 'train'")
    judged = rows.where("split <> 'train'")

    def pair(model: str, target: str, value) -> F.Column:
        return F.struct(F.lit(model).alias("model"), F.lit(target).alias("target"), F.col(target).alias("actual"),
                        value.cast("double").alias("predicted"))

    means = train.agg(F.struct(*[F.avg(t).alias(t) for t in targets]).alias("m")).scalar()
    long = judged.select("split", F.explode(F.array(
        *[pair("Train Mean", t, means[t]) for t in targets],
        *[pair("Previous Performance", t, F.col(last[t])) for t in targets])).alias("p"))
    return long.select("split", "p.*")


def error_metrics(predictions: DataFrame, by: Sequence[str] = ("model", "target")) -> DataFrame:
    """MAE, RMSE, R2, mean error and median absolute error of the rows with both values."""
    known = predictions.where("actual IS NOT NULL AND predicted IS NOT NULL")
    error = F.col("predicted") - F.col("actual")
    named = known.select(*by, "actual", error.alias("error"), F.abs(error).alias("size"),
                         F.concat_ws("\x1f", *by).alias("name"))
    middle = group_percentiles(named, "name", "size", (0.5,)).select("name", F.col("value").alias("median_absolute_error"))
    per = named.groupBy("name", *by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("size").alias("mae"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg(F.col("error") ** 2), F.var_pop("actual"))).alias("r2"),
        F.avg("error").alias("mean_error"))
    return per.join(middle, "name", "left").drop("name")


def metric_rank(metrics: DataFrame, by: str = "target", value: str = "mae") -> DataFrame:
    """Rank of each model within its target; equal values share the lowest rank."""
    return metrics.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(value)))


def best_models(metrics: DataFrame) -> DataFrame:
    """First model per target by MAE, then RMSE."""
    return metrics.groupBy("target").agg(F.min_by(
        F.struct("model", "mae", "rmse", "r2"), F.struct("mae", "rmse", "model")).alias("b")).select("target", "b.*")


def improvement(best: DataFrame, baseline: DataFrame) -> DataFrame:
    """Gain of the selected models over a baseline's MAE in percent."""
    base = baseline.select("target", F.col("mae").alias("baseline_mae"))
    return best.join(base, "target", "left").withColumn(
        "improvement_pct", F.try_divide(F.col("baseline_mae") - F.col("mae"), F.col("baseline_mae")) * 100)


def metric_pivot(metrics: DataFrame, models: Sequence[str], value: str = "mae") -> DataFrame:
    """One row per target, one column per model."""
    return metrics.groupBy("target").pivot("model", list(models)).agg(F.first(value))


def error_percentiles(predictions: DataFrame, probs: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Absolute-error percentiles and maximum, mean error and population deviation per target."""
    error = F.col("predicted") - F.col("actual")
    sized = predictions.where("actual IS NOT NULL AND predicted IS NOT NULL").select(
        "target", error.alias("error"), F.abs(error).alias("size"))
    names = [f"p{round(p * 100)}" for p in probs]
    spread = group_percentiles(sized, "target", "size", probs).groupBy("name").pivot("prob", list(probs)).agg(
        F.first("value")).toDF("target", *names)
    basics = sized.groupBy("target").agg(F.max("size").alias("max_error"), F.avg("size").alias("mean_abs_error"),
                                         F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("std_error"))
    return basics.join(spread, "target")


def bias(predictions: DataFrame) -> DataFrame:
    error = F.col("predicted") - F.col("actual")
    per = predictions.groupBy("target").agg(F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mean_absolute_error"))
    return per.withColumn("direction", F.when(F.col("mean_error") > 0, "OVERPREDICTION").when(
        F.col("mean_error") < 0, "UNDERPREDICTION").otherwise("NEUTRAL"))


def distribution(predictions: DataFrame) -> DataFrame:
    """Actual against predicted mean, deviation and extremes per target."""
    cols = [agg(c).alias(f"{c}_{n}") for c in ("actual", "predicted")
            for n, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return predictions.groupBy("target").agg(*cols)


def total_consistency(wide: DataFrame, prefix: str = "predicted_") -> DataFrame:
    """Predicted total against the sum of the predicted lifts: differences and a verdict, in one row."""
    parts = sum(F.col(f"{prefix}{t}") for t in TARGETS if t != "total")
    gaps = wide.select(F.abs(F.col(f"{prefix}total") - parts).alias("gap")).where("gap IS NOT NULL")
    middle = exact_percentiles(gaps, ("gap",), (0.5,)).select("value").scalar()
    per = gaps.agg(
        F.count(F.lit(1)).alias("predictions"), F.avg("gap").alias("mean_difference"), F.max("gap").alias("max_difference"),
        F.count_if(F.col("gap") <= GOOD_WITHIN).alias("within_5"))
    return per.withColumns({"median_difference": middle, "status": F.when(
        F.col("mean_difference") <= GOOD_WITHIN, "GOOD").when(
        F.col("mean_difference") <= ACCEPTABLE_WITHIN, "ACCEPTABLE").otherwise("INDEPENDENT_TARGETS_DIFFER")})


def prediction_difference(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str],
                          rtol: float = 1e-10, atol: float = 1e-8) -> DataFrame:
    """Largest difference of two prediction sets per column and whether all pairs agree within tolerance."""
    other = right.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    close = {c: F.abs(F.col(c) - F.col(f"_{c}")) <= atol + rtol * F.abs(F.col(f"_{c}")) for c in columns}
    return left.join(other, list(key)).agg(
        F.count(F.lit(1)).alias("rows"), *[F.max(F.abs(F.col(c) - F.col(f"_{c}"))).alias(f"max_{c}") for c in columns],
        F.bool_and(F.coalesce(sum(t.cast("int") for t in close.values()) == len(columns), F.lit(False))).alias("equal"))
