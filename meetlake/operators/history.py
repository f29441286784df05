"""Next-competition examples and their leakage audit, at the grain of single results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.functions.text import blank_to_null, strip
from meetlake.operators.ordered import running_before
from meetlake.schema import LIFT_BLOCK, LIFTS, TARGETS, require_columns

PREVIOUS = (*LIFT_BLOCK, "total", "bodyweight")


def checked_history_keys(results: DataFrame, athlete: str = "athlete_id") -> DataFrame:
    """Trim the keys; a missing athlete, year or competition fails the job."""
    require_columns(results, (athlete, "year", "competition"))

    def need(c: Column, what: str, kind: str) -> Column:
        return F.coalesce(c, F.raise_error(F.lit(f"missing or invalid {what}")).cast(kind))

    return results.withColumns({
        athlete: need(blank_to_null(strip(F.col(athlete).cast("string"))), athlete, "string"),
        "year": need(F.col("year").try_cast("int"), "year", "int"),
        "competition": need(blank_to_null(strip(F.col("competition"))), "competition", "string")})


def rejected_history_keys(results: DataFrame, athlete: str = "athlete_id") -> DataFrame:
    """The rows checked_history_keys would fail on, for a side output."""
    return results.where(blank_to_null(strip(F.col(athlete).cast("string"))).isNull()
                         | F.col("year").try_cast("int").isNull()
                         | blank_to_null(strip(F.col("competition"))).isNull())


def history_examples(results: DataFrame, athlete: str = "athlete_id", tie: str = "seq") -> DataFrame:
    """One row per result that has earlier results of the same athlete.

    History is ordered by year, competition, then filing order. ``previous`` is the whole last
    competition; the maxima run over all earlier ones, attempts separately from bests.
    """
    rows = checked_history_keys(results, athlete)
    measures = {
        "previous_competition_count": ("count", F.lit(1)),
        "previous": ("last", F.struct(*PREVIOUS)),
        **{f"historical_best_{lift}": ("max", F.col(f"best_{lift}")) for lift in LIFTS},
        "historical_best_total": ("max", F.col("total")),
        **{f"historical_best_{lift}_attempt": ("max", F.greatest(*[f"{lift}_{k}" for k in (1, 2, 3)]))
           for lift in LIFTS},
    }
    seen = running_before(rows, [athlete], ["year", "competition", tie], measures)
    return seen.where("previous_competition_count > 0").select(
        athlete, tie, F.col("year").alias("target_year"), F.col("competition").alias("target_competition"),
        F.struct(*measures).alias("features"), F.struct(*TARGETS).alias("target"))


def flat_examples(examples: DataFrame) -> DataFrame:
    """Examples with features, previous competition and target as plain columns."""
    keep = [c for c in examples.columns if c not in ("features", "target")]
    wide = examples.select(*keep, "features.*", F.struct(
        *[F.col(f"target.{t}").alias(f"target_{t}") for t in TARGETS]).alias("target"))
    return wide.select("*", *[F.col(f"previous.{c}").alias(f"previous_{c}") for c in PREVIOUS],
                       "target.*").drop("previous", "target")


def target_complete(target: str = "target") -> Column:
    """All four target values are present."""
    return reduce(lambda a, b: a & b, [F.col(f"{target}.{t}").isNotNull() for t in TARGETS])


def leakage_audit(results: DataFrame, athlete: str = "athlete_id", tie: str = "seq") -> DataFrame:
    """Counters over the examples that history_examples makes of ``results``; all zero means the history is clean.

    The rows are counted once per (athlete, year, competition, signature); every counter follows from
    sums and minima over those counts, so no athlete's rows are ever gathered. The ordering by year and
    competition holds by construction, hence the two constant zeros.
    """
    rows = checked_history_keys(results, athlete)
    counted = rows.groupBy(athlete, "year", "competition", *TARGETS).agg(F.count(F.lit(1)).alias("n"))
    here = F.struct("year", "competition")

    meets = counted.groupBy(athlete, "year", "competition").agg(F.sum("n").alias("n"))
    per_athlete = meets.groupBy(athlete).agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("crowded"),
        (F.min_by("n", here) > 1).cast("int").alias("first_crowded"))
    sums = per_athlete.agg(
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("total_examples"),
        F.coalesce(F.sum(F.col("crowded") - F.col("first_crowded")), F.lit(0)).alias("examples_with_target_in_history"))

    # among the meets that share an athlete and a signature all but the first repeat it; a result counts
    # when it is its athlete's only one at that meet
    size = meets.withColumnRenamed("n", "at_meet")
    repeats = counted.join(size, [athlete, "year", "competition"]).groupBy(athlete, *TARGETS).agg(
        (F.count_if(F.col("at_meet") == 1) - (F.min_by("at_meet", here) == 1).cast("int")).alias("r")).agg(
        F.coalesce(F.sum("r"), F.lit(0)))
    zero = F.lit(0).cast("bigint")
    return sums.withColumn("examples_with_target_values_in_history", repeats.scalar()).select(
        "total_examples", "examples_with_target_in_history", zero.alias("examples_with_future_year_in_history"),
        "examples_with_target_values_in_history", zero.alias("athlete_ordering_violations"),
        (F.col("examples_with_target_in_history") + F.col("examples_with_target_values_in_history") == 0).alias("passed"))


def order_audit(rows: DataFrame, position: str, athlete: str = "athlete_id") -> DataFrame:
    """The same counters where the history of a row is what ``position`` puts before it, whoever made that order.

    Every row but an athlete's first is an example. A target is in its history if its year and competition are not its
    athlete's only row of them; a history has the future in it if it holds a later year and competition; values are those
    of the target's four results; an ordering violation is a row that comes before its predecessor.
    """
    rows = checked_history_keys(rows, athlete)
    here = F.struct("year", "competition")
    signature = [athlete, *TARGETS]
    first = rows.groupBy(*signature).agg(F.min(position).alias("first"))
    at_meet = rows.groupBy(athlete, "year", "competition").agg(F.count(F.lit(1)).alias("at_meet"))
    same = F.lit(True)
    for c in signature:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    tagged = rows.alias("r").join(first.alias("f"), same).select("r.*", "first").join(
        at_meet, [athlete, "year", "competition"]).select(
        athlete, position, here.alias("here"), (F.col("at_meet") != 1).alias("crowded"),
        (F.col("first") < F.col(position)).alias("repeated"))
    # a scan of parts, so one athlete's rows are no task of their own
    seen = running_before(tagged, [athlete], [position], {
        "n": ("count", F.lit(1)), "latest": ("max", F.col("here")), "last": ("last", F.col("here"))})

    def n(name: str, test: Column) -> Column:
        return F.count_if(F.coalesce(test, F.lit(False))).alias(name)

    c = F.col
    counted = seen.where("n > 0").agg(
        F.count(F.lit(1)).alias("total_examples"), n("examples_with_target_in_history", c("crowded")),
        n("examples_with_future_year_in_history", ~c("crowded") & (c("latest") > c("here"))),
        n("examples_with_target_values_in_history", ~c("crowded") & c("repeated")),
        n("athlete_ordering_violations", c("here") < c("last")))
    return counted.withColumn("passed", sum(c(x) for x in counted.columns[1:]) == 0)
