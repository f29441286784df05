"""Athlete identity: collisions, their resolution, and the resolved ids.

Two rows of one athlete id, year and competition collide. Pairs are judged by birth date first, then
by weight class. All pair counts of a group follow from a few group totals, so pairs are never formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.functions.text import (
    blank_to_null, optional_text, resolved_athlete_id, resolved_confidence, strip,
)

CONTEXT = ("year", "competition", "division", "weight_class", "equipment", "bodyweight")
GROUP = ("athlete_id", "year", "competition")
ATTRIBUTES = ("date_of_birth", "team", "bodyweight", "division", "weight_class", "equipment")
_PAIRS = "decimal(38,0)"


def identity_contexts(results: DataFrame) -> DataFrame:
    """Trimmed identity context of each row; a missing athlete id or year fails the job."""
    def need(c: Column, what: str, kind: str) -> Column:
        return F.coalesce(c, F.raise_error(F.lit(f"missing {what}")).cast(kind))
    text = {c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")).alias(c)
            for c in ("competition", "division", "weight_class", "equipment")}
    return results.select(
        need(blank_to_null(strip(F.col("athlete_id").cast("string"))), "athlete_id", "string").alias("athlete_id"),
        need(F.col("year").try_cast("int"), "year", "int").alias("year"),
        *text.values(), F.col("bodyweight").try_cast("double").alias("bodyweight"))


def identity_collisions(results: DataFrame) -> DataFrame:
    """Distinct contexts of every athlete id that has more than one, one row per context."""
    distinct = identity_contexts(results).select("athlete_id", *CONTEXT).distinct()
    many = distinct.groupBy("athlete_id").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    return distinct.join(many, "athlete_id")


def same_meet_collisions(results: DataFrame) -> DataFrame:
    """Groups of (athlete, year, competition) with more than one row, and their distinct contexts."""
    per_context = identity_contexts(results).groupBy("athlete_id", *CONTEXT).agg(F.count(F.lit(1)).alias("n"))
    return per_context.groupBy(*GROUP).agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("contexts")).where("records > 1")


def collision_statistics(results: DataFrame) -> DataFrame:
    """Athlete ids, ids with several contexts, and same-meet groups, from one grouping chain."""
    per_context = identity_contexts(results).groupBy("athlete_id", *CONTEXT).agg(F.count(F.lit(1)).alias("n"))
    per_meet = per_context.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"))
    per_athlete = per_meet.groupBy("athlete_id").agg(
        F.sum("contexts").alias("contexts"), F.count_if(F.col("n") > 1).alias("meets"))
    return per_athlete.agg(
        F.count(F.lit(1)).alias("athlete_ids"), F.count_if(F.col("contexts") > 1).alias("candidate_collision_ids"),
        F.coalesce(F.sum("meets"), F.lit(0)).alias("same_competition_collision_groups"))


def pair_decision(left: str, right: str) -> Column:
    """Decision and reason for two candidate structs (columns ``left`` and ``right``)."""
    born = [optional_text(F.col(f"{s}.date_of_birth")) for s in (left, right)]
    weight = [optional_text(F.col(f"{s}.weight_class")) for s in (left, right)]
    both = born[0].isNotNull() & born[1].isNotNull()

    def verdict(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))

    return (F.when(both & (born[0] != born[1]), verdict("SPLIT", "DIFFERENT_DATE_OF_BIRTH"))
            .when(both, verdict("SAME", "SAME_DATE_OF_BIRTH"))
            .when(weight[0] != weight[1], verdict("SPLIT", "DIFFERENT_WEIGHT_CLASS_WITHOUT_DOB"))
            .otherwise(verdict("UNRESOLVED", "INSUFFICIENT_IDENTITY_METADATA")))


def collision_rows(results: DataFrame) -> DataFrame:
    """Rows that belong to a colliding group."""
    groups = results.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return results.join(groups, list(GROUP), "left_semi")


def resolve_groups(results: DataFrame) -> DataFrame:
    """Classification and pair counts by reason of every colliding group.

    With n rows per value, n(n-1)/2 pairs agree on the value; pairs that differ are all pairs less
    those. That gives every reason from sums of n and n squared per group.
    """
    cells = collision_rows(results).groupBy(
        *GROUP, optional_text(F.col("date_of_birth")).alias("born"),
        optional_text(F.col("weight_class")).alias("weight")).agg(F.count(F.lit(1)).alias("n"))
    born, weight = F.col("born"), F.col("weight")

    def fact(kind: str, value: Column, test: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    facts = F.filter(F.array(
        fact("all", F.lit(None).cast("string"), F.lit(True)), fact("born", born, born.isNotNull()),
        fact("weight", weight, weight.isNotNull()),
        fact("both", weight, born.isNotNull() & weight.isNotNull())), lambda x: x.isNotNull())
    sized = cells.select(*GROUP, "n", F.explode(facts).alias("f")).groupBy(*GROUP, "f.kind", "f.value").agg(
        F.sum("n").cast(_PAIRS).alias("n"))

    def rows_of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast(_PAIRS)).cast(_PAIRS)

    def same_of(kind: str) -> Column:
        n = F.col("n")
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, (n * (n - 1)).cast(_PAIRS))), F.lit(0)).cast(_PAIRS)

    kinds = ("all", "born", "weight", "both")
    sums = sized.groupBy(*GROUP).agg(*[rows_of(k).alias(f"n_{k}") for k in kinds],
                                     *[same_of(k).alias(f"s_{k}") for k in kinds])

    def ordered_pairs(kind: str) -> Column:
        n = F.col(f"n_{kind}")
        return (n * (n - 1)).cast(_PAIRS)

    def half(c: Column) -> Column:
        return (c / 2).cast(_PAIRS)

    same_born = half(F.col("s_born"))
    other_born = half(ordered_pairs("born") - F.col("s_born"))
    other_weight = half((ordered_pairs("weight") - F.col("s_weight")) - (ordered_pairs("both") - F.col("s_both")))
    all_pairs = half(ordered_pairs("all"))
    counted = sums.select(
        *GROUP, F.col("n_all").cast("bigint").alias("records"), all_pairs.alias("pairs"),
        same_born.alias("same_date_of_birth"), other_born.alias("different_date_of_birth"),
        other_weight.alias("different_weight_class_without_dob"))
    known = F.col("same_date_of_birth") + F.col("different_date_of_birth") + F.col("different_weight_class_without_dob")
    split = F.col("different_date_of_birth") + F.col("different_weight_class_without_dob")
    return counted.select(
        *GROUP, "records",
        F.when(F.col("same_date_of_birth") == F.col("pairs"), F.lit("SAME"))
        .when(split > 0, F.lit("SPLIT")).otherwise(F.lit("UNRESOLVED")).alias("classification"),
        "same_date_of_birth", "different_date_of_birth", "different_weight_class_without_dob",
        (F.col("pairs") - known).cast(_PAIRS).alias("insufficient_identity_metadata"))


def group_attributes(results: DataFrame) -> DataFrame:
    """Distinct known attribute values of every colliding group, one row per value."""
    rows = collision_rows(results).select(*GROUP, *[F.col(a).cast("string").alias(a) for a in ATTRIBUTES])
    return rows.unpivot(list(GROUP), list(ATTRIBUTES), "attribute", "value").where(
        "value IS NOT NULL AND value <> ''").distinct()


def resolution_summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("classification").agg(
        F.count(F.lit(1)).alias("collision_groups"), F.sum("records").alias("records"))


def apply_resolution(results: DataFrame, groups: DataFrame) -> DataFrame:
    """Set resolved id and confidence; an unresolved group gets no id even where a birth date is known."""
    lookup = groups.select(F.col("athlete_id").alias("g_id"), F.col("year").alias("g_year"),
                           F.col("competition").alias("g_meet"), "classification")
    joined = results.join(lookup, (strip(F.col("athlete_id")) == F.col("g_id")) & (F.col("year") == F.col("g_year"))
                          & (strip(F.col("competition")) == F.col("g_meet")), "left")
    name, born, kind = F.col("athlete_name"), F.col("date_of_birth"), F.col("classification")
    strong = F.coalesce((name != "") & (born != ""), F.lit(False))
    unresolved = F.coalesce(kind == "UNRESOLVED", F.lit(False))
    resolved = F.when(~unresolved, F.when(strong, resolved_athlete_id(name, born)).otherwise(
        strip(F.col("athlete_id"))))
    confidence = (F.when(unresolved, F.lit("UNRESOLVED")).when(~strong, F.lit("CANDIDATE"))
                  .when(kind == "SAME", F.lit("RESOLVED_SAME")).when(kind == "SPLIT", F.lit("RESOLVED_SPLIT"))
                  .otherwise(F.lit("HIGH")))
    return joined.withColumns({"resolved_athlete_id": resolved, "identity_confidence": confidence}).select(
        *dict.fromkeys([*results.columns, "resolved_athlete_id", "identity_confidence"]))


def assign_by_birth_date(results: DataFrame) -> DataFrame:
    """The older rule: a birth date alone decides; a dated row without a name fails the job."""
    name, born = F.col("athlete_name"), blank_to_null(F.col("date_of_birth"))
    by_date = F.coalesce(resolved_athlete_id(name, born), F.raise_error(F.lit(
        "a dated row needs an athlete name")).cast("string"))
    return results.withColumns({
        "resolved_athlete_id": F.when(born.isNotNull(), by_date).otherwise(F.col("athlete_id")),
        "identity_confidence": F.when(born.isNotNull(), resolved_confidence(born)).otherwise(F.lit("CANDIDATE"))})


def resolution_counters(resolved: DataFrame) -> DataFrame:
    """Rows per confidence and distinct resolved ids, added up per id first."""
    labels = {"high": "HIGH", "same": "RESOLVED_SAME", "split": "RESOLVED_SPLIT", "candidate": "CANDIDATE",
              "unresolved": "UNRESOLVED"}
    per_id = resolved.groupBy("resolved_athlete_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("identity_confidence") == v).alias(k) for k, v in labels.items()])
    return per_id.agg(F.sum("n").alias("total"), F.count(F.nullif("resolved_athlete_id", F.lit(""))).alias("unique"),
                      *[F.sum(k).alias(k) for k in labels])
