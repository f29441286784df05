"""Data-quality reports over canonical results and extracted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.functions.numbers import failed_count, non_negative_or_null, total_differs
from meetlake.functions.text import blank_to_null, normal_name, strip
from meetlake.schema import ATTEMPTS, BESTS, EQUIPMENT, LIFTS, MEASURES

# fixed values: what the reports name
REQUIRED_VALUES = ("bodyweight", *BESTS, "total")
HISTOGRAMS = ("year", "competition", "division", "weight_class", "equipment")
AUDIT_REQUIRED = ("athlete_id", "resolved_athlete_id", "identity_confidence", "competition", "year",
                  "division", "weight_class", "equipment")
AUDIT_KEY = ("resolved_athlete_id", "year", "competition", "division", "weight_class", "equipment")
CONFIDENCES = ("HIGH", "RESOLVED_SAME", "RESOLVED_SPLIT", "CANDIDATE", "UNRESOLVED")


def _n(name: str, test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False))).alias(name)


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


# ---- profile and statistics -------------------------------------------------------------------

def dataset_profile(results: DataFrame) -> DataFrame:
    """One row: sizes, distinct counts, equipment counts, per-lift missing, valid and failed counts."""
    lifts = []
    for lift in LIFTS:
        best = F.col(f"best_{lift}")
        lifts += [_n(f"{lift}_missing", best.isNull()), F.count(best).alias(f"{lift}_valid"),
                  F.coalesce(F.sum(failed_count([F.col(f"{lift}_{k}") for k in (1, 2, 3)])), F.lit(0)).alias(
                      f"{lift}_failed_attempts")]
    return results.agg(
        F.count(F.lit(1)).alias("total_records"), F.countDistinct("athlete_id").alias("unique_athletes"),
        F.countDistinct("competition").alias("competitions"), F.countDistinct("year").alias("years"),
        F.countDistinct("division").alias("divisions"), F.countDistinct("weight_class").alias("weight_classes"),
        *[_n(f"equipment_{e.lower()}", F.col("equipment") == e) for e in EQUIPMENT],
        *lifts, _n("total_missing", F.col("total").isNull()), F.count("total").alias("total_valid"))


def histograms(results: DataFrame, dimensions: Sequence[str] = HISTOGRAMS) -> DataFrame:
    """Record counts per value of every dimension in one pass: dimension, key, records."""
    keyed = results.select(*[F.col(c).cast("string").alias(c) for c in dimensions])
    return keyed.unpivot([], list(dimensions), "dimension", "key").groupBy("dimension", "key").agg(
        F.count(F.lit(1)).alias("records"))


def athletes_by_count(results: DataFrame, athlete: str = "athlete_id") -> DataFrame:
    """How many athletes have how many records."""
    per_athlete = results.groupBy(athlete).agg(F.count(F.lit(1)).alias("records"))
    return per_athlete.groupBy("records").agg(F.count(F.lit(1)).alias("athletes"))


def numeric_statistics(results: DataFrame, fields: Sequence[str] = REQUIRED_VALUES) -> DataFrame:
    """Count, minimum, maximum and average per field; missing values do not count."""
    long = results.select(*fields).unpivot([], list(fields), "field", "value")
    return long.groupBy("field").agg(F.count("value").alias("count"), F.min("value").alias("minimum"),
                                     F.max("value").alias("maximum"), F.avg("value").alias("average"))


# ---- equipment --------------------------------------------------------------------------------

def equipment_audit(results: DataFrame) -> DataFrame:
    """Equipment labels per competition and year."""
    return results.groupBy("competition", "year").agg(
        *[_n(e.lower(), F.col("equipment") == e) for e in EQUIPMENT]).withColumn(
        "total", F.col("classic") + F.col("equipped") + F.col("unknown"))


def equipment_totals(audit: DataFrame) -> DataFrame:
    return audit.agg(
        _total("total").alias("total_records"), _total("classic").alias("classic_records"),
        _total("equipped").alias("equipped_records"), _total("unknown").alias("unknown_records"),
        _n("competitions_with_unknown", F.col("unknown") > 0))


def unknown_equipment(results: DataFrame) -> DataFrame:
    return results.where(F.col("equipment") == "UNKNOWN")


# ---- integrity --------------------------------------------------------------------------------

def _issue(test: Column, field: str, kind: str, value: Column, message: str) -> Column:
    return F.when(test, F.struct(F.lit(field).alias("field"), F.lit(kind).alias("issue_type"),
                                 value.alias("value"), F.lit(message).alias("message")))


def integrity_issues(results: DataFrame) -> DataFrame:
    """Long table of missing values, negative values and totals that differ from the sum of bests.

    Failed attempts are negative by convention and are listed as negative values here all the same.
    """
    found = [_issue(F.col(c).isNull(), c, "MISSING_VALUE", F.col(c), f"{c} is missing") for c in REQUIRED_VALUES]
    found += [_issue(F.col(c) < 0, c, "INVALID_VALUE", F.col(c), f"{c} cannot be negative") for c in MEASURES]
    found.append(_issue(total_differs((*BESTS, "total")), "total", "TOTAL_MISMATCH", F.col("total"),
                        "Total does not equal best squat + best bench + best deadlift"))
    held = F.filter(F.array(*found), lambda x: x.isNotNull())
    return results.select("athlete_id", "competition", "year", F.explode(held).alias("issue")).select(
        "athlete_id", "competition", "year", "issue.*")


def _integrity_counts(results: DataFrame) -> DataFrame:
    """Per (athlete, competition, year): records, issue counts and equipment counts."""
    missing = sum(F.col(c).isNull().cast("int") for c in REQUIRED_VALUES)
    invalid = failed_count([F.col(c) for c in MEASURES])
    counted = results.select("athlete_id", "competition", "year", missing.alias("missing"), invalid.alias("invalid"),
                             total_differs((*BESTS, "total")).cast("int").alias("mismatch"), "equipment")
    return counted.groupBy("athlete_id", "competition", "year").agg(
        F.count(F.lit(1)).alias("records"), *[F.sum(c).alias(c) for c in ("missing", "invalid", "mismatch")],
        *[_n(e.lower(), F.col("equipment") == e) for e in EQUIPMENT])


def _integrity_totals() -> list[Column]:
    whole = F.col("missing") + F.col("invalid") + F.col("mismatch")
    return [
        _total("records").alias("total_records"), _n("records_with_issues", whole > 0),
        F.coalesce(F.sum(whole), F.lit(0)).alias("total_issues"),
        _total("missing").alias("missing_value_issues"), _total("invalid").alias("invalid_value_issues"),
        _total("mismatch").alias("total_mismatch_issues")]


def integrity_summary(results: DataFrame) -> DataFrame:
    """Counters of the integrity audit without listing the issues."""
    return _integrity_counts(results).agg(*_integrity_totals())


def quality_report(results: DataFrame) -> DataFrame:
    """One row with nested dataset, equipment and integrity counters, from one grouping."""
    labels = [e.lower() for e in EQUIPMENT]
    sums = _integrity_counts(results).agg(*_integrity_totals(), *[_total(e) for e in labels])
    counters = [c for c in sums.columns if c not in ("total_records", *labels)]
    return sums.select(F.struct("total_records").alias("dataset"), F.struct(*labels).alias("equipment"),
                       F.struct(*counters).alias("integrity"))


# ---- extracted rows ---------------------------------------------------------------------------

def validation_issues(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Issues of extracted rows and of failed sources: source_file, issue_type, athlete_name, fields."""
    c = F.col

    def issue(test: Column, kind: str, fields: Sequence[str]) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(
            F.lit(kind).alias("issue_type"), F.array(*[F.lit(f) for f in fields]).cast("array<string>").alias("fields")))

    has_row = c("status") != "REVIEW"
    checks = [issue(~has_row, "MISSING_ROW", ())]
    checks += [issue(has_row & t, k, f) for t, k, f in (
        (c("weight_class").isNull(), "MISSING_WEIGHT_CLASS", ("weight_class",)),
        (c("division").isNull(), "MISSING_DIVISION", ("division",)),
        (~non_negative_or_null(c("bodyweight")), "INVALID_BODYWEIGHT", ("bodyweight",)),
        *[(~non_negative_or_null(c(b)), "INVALID_BEST_LIFT", (b,)) for b in BESTS],
        (total_differs((*BESTS, "total")), "TOTAL_MISMATCH", ("total", *BESTS)),
        (~non_negative_or_null(c("total")), "INVALID_TOTAL", ("total",)))]
    per_row = rows.select(
        "source_file", F.coalesce("athlete_name", F.lit("")).alias("athlete_name"),
        F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("i")).select(
        "source_file", "i.issue_type", "athlete_name", "i.fields")
    none = F.array().cast("array<string>").alias("fields")
    copies = repeated_rows(rows).select("source_file", F.lit("DUPLICATE_ROW").alias("issue_type"), "athlete_name", none)
    failed = sources.where("status <> 'SUCCESS'").select(
        "source_file", F.lit("SOURCE_ERROR").alias("issue_type"), F.lit("").alias("athlete_name"), none)
    return per_row.unionByName(copies).unionByName(failed)


def repeated_rows(rows: DataFrame) -> DataFrame:
    """Rows of a sheet that repeat an earlier row's name, section, bodyweight and total."""
    key = ["source_file", F.upper(strip(F.col("athlete_name"))).alias("name"), "weight_class", "division",
           "bodyweight", "total"]
    real = rows.where("status <> 'REVIEW'").select(*key, "line_no", "athlete_name")
    names = ["source_file", "name", "weight_class", "division", "bodyweight", "total"]
    first = real.groupBy(*names).agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select(*[F.col(k).alias(f"k_{k}") for k in names], "first_line")
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    return real.join(first, same).where("line_no > first_line").select("source_file", "line_no", "athlete_name")


def validation_report(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The validation counters in one row."""
    c = F.col
    real = c("status") != "REVIEW"
    key = ("source_file", "name", "weight_class", "division", "bodyweight", "total")
    tests = {
        "missing_weight_class": c("weight_class").isNull(), "missing_division": c("division").isNull(),
        "invalid_bodyweight": c("bodyweight") < 0, "total_mismatches": total_differs((*BESTS, "total")),
        "invalid_total": c("total") < 0,
    }
    marked = rows.withColumns({
        "name": normal_name(c("athlete_name")), "real": real.cast("int"),
        "parsed_rows": (real & (c("status") == "PARSED")).cast("int"),
        "incomplete_rows": (real & (c("status") == "INCOMPLETE")).cast("int"),
        "review_rows": (~real).cast("int"),
        "invalid_best_lifts": F.when(real, failed_count([c(b) for b in BESTS])).otherwise(0),
        **{k: (real & F.coalesce(t, F.lit(False))).cast("int") for k, t in tests.items()}})
    sums = ["parsed_rows", "incomplete_rows", "review_rows", "invalid_best_lifts", *tests]
    per_key = marked.groupBy(*key, "real").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums])
    row_side = per_key.agg(
        F.coalesce(F.sum(c("n") * c("real")), F.lit(0)).alias("total_rows"), *[_total(s) for s in sums],
        F.coalesce(F.sum((c("n") - 1) * c("real")), F.lit(0)).alias("duplicate_rows"))
    source_side = sources.agg(F.count(F.lit(1)).alias("total_sources"),
                              _n("successful_sources", c("status") == "SUCCESS"),
                              _n("failed_sources", c("status") != "SUCCESS"))
    names = [*source_side.columns, *row_side.columns]
    # two one-row tables with different columns: stack them and take each column's only value
    return source_side.unionByName(row_side, allowMissingColumns=True).agg(*[F.max(n).alias(n) for n in names])


# ---- final audit ------------------------------------------------------------------------------

def final_audit(resolved: DataFrame, key: Sequence[str] = AUDIT_KEY) -> DataFrame:
    """Counters of the last gate before release, and PASS or FAIL.

    Rows are first added up per result key, which also counts duplicate keys: one shuffle in all. Measures may still be
    text: what is no number is counted as invalid and plays no part in the other counters.
    """
    c = F.col
    resolved = resolved.select("*", *[c(m).alias(f"raw_{m}") for m in MEASURES]).withColumns(
        {m: c(m).try_cast("double") for m in MEASURES})
    absent = {f"missing_{r}": blank_to_null(strip(c(r).cast("string"))).isNull() for r in AUDIT_REQUIRED}
    flags = {
        **{k: t.cast("int") for k, t in absent.items()},
        **{f"confidence_{k.lower()}": (c("identity_confidence") == k).cast("int") for k in CONFIDENCES},
        "invalid_numerics": sum((c(f"raw_{m}").isNotNull() & c(m).isNull()).cast("int") for m in MEASURES),
        "zero_attempts": sum(F.coalesce((c(a) == 0).cast("int"), F.lit(0)) for a in ATTEMPTS),
        "total_mismatches": total_differs((*BESTS, "total"), 0.01).cast("int"),
    }
    per_key = resolved.select(*key, *[t.alias(f"f_{k}") for k, t in flags.items()]).groupBy(*key).agg(
        F.count(F.lit(1)).alias("records"), *[F.sum(f"f_{k}").alias(k) for k in flags])
    sums = per_key.agg(
        _total("records").alias("total_records"), *[_total(k) for k in flags],
        _n("duplicate_groups", c("records") > 1),
        F.coalesce(F.sum(F.when(c("records") > 1, c("records"))), F.lit(0)).alias("records_in_duplicate_groups"))
    bad = sum(c(k) for k in (*absent, "invalid_numerics", "total_mismatches", "duplicate_groups"))
    return sums.withColumn("result", F.when(bad > 0, F.lit("FAIL")).otherwise(F.lit("PASS")))
