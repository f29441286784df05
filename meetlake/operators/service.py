"""The application table: identity bridge, lookups, histories and filtered result lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions.text import blank_to_null, strip
from meetlake.schema import MEASURES, require_columns

# fixed values: the columns that exports and the canonical table must have
REQUIRED = ("athlete_id", "resolved_athlete_id", "year", "competition", "division", "equipment", "weight_class",
            *MEASURES, "place", "lot", "team", "date_of_birth", "identity_confidence")
CANONICAL = ("athlete_id", "resolved_athlete_id", "athlete_name", "year", "competition", "date_of_birth")
BRIDGE_KEYS = ("athlete_id", "year", "competition", "date_of_birth")
TEXT_COLUMNS = ("athlete_id", "resolved_athlete_id", "athlete_name", "competition", "division", "equipment",
                "team", "date_of_birth", "identity_confidence")
WHOLE_NUMBERS = ("year", "place", "lot")


def trim_texts(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: strip(F.col(c).cast("string")) for c in columns if c in df.columns})


def coerce_numbers(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """Unreadable numbers become null; years, places and lots become whole numbers.

    Weight classes stay text, so that the open class keeps its name; a class read as a number loses its decimals.
    """
    whole = {c: F.col(c).try_cast("double").try_cast("int") for c in WHOLE_NUMBERS if c in df.columns}
    if "weight_class" in df.columns:
        text = strip(F.col("weight_class").cast("string"))
        whole["weight_class"] = F.coalesce(text.try_cast("double").try_cast("int").cast("string"), text)
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns} | whole)


def application_table(raw: DataFrame) -> DataFrame:
    """Checked, trimmed and coerced rows of a tabular export."""
    return coerce_numbers(trim_texts(require_columns(raw, REQUIRED)))


# ---- identity bridge --------------------------------------------------------------------------

def bridge(canonical: DataFrame) -> DataFrame:
    """One row per bridge key with its resolved id, name and confidence; keys with two ids are flagged."""
    order = F.struct(F.col("resolved_athlete_id").isNull(), "resolved_athlete_id", "athlete_name")
    return require_columns(canonical, CANONICAL).groupBy(*BRIDGE_KEYS).agg(
        F.min_by("resolved_athlete_id", order).alias("resolved_athlete_id"),
        F.min_by("athlete_name", order).alias("athlete_name"),
        F.min_by("identity_confidence", order).alias("identity_confidence"),
        (F.max("resolved_athlete_id") > F.min("resolved_athlete_id")).alias("ambiguous"))


def ambiguous_keys(canonical: DataFrame) -> DataFrame:
    return bridge(canonical).where("ambiguous").select(*BRIDGE_KEYS)


def _same_keys(left: str, right: str) -> Column:
    """Key equality where two missing birth dates agree."""
    same = F.lit(True)
    for k in BRIDGE_KEYS:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def bridge_unmatched(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Row keys that no canonical record carries."""
    keys = rows.select(*BRIDGE_KEYS).distinct().alias("r")
    return keys.join(canonical.select(*BRIDGE_KEYS).alias("c"), _same_keys("r", "c"), "left_anti")


def attach_identity(rows: DataFrame, canonical: DataFrame, strict: bool = True) -> DataFrame:
    """Replace stale ids by the canonical identity.

    In strict mode a row whose key is ambiguous, unknown or without an id or name fails the job at the
    row, with no extra pass over the data.
    """
    stale = [c for c in rows.columns if c not in ("resolved_athlete_id", "athlete_name", "identity_confidence")]
    joined = rows.select(*stale).alias("r").join(bridge(canonical).alias("c"), _same_keys("r", "c"), "left")
    new = {c: F.col(f"c.{c}") for c in ("resolved_athlete_id", "athlete_name", "identity_confidence")}
    if strict:
        clash = F.when(F.col("c.ambiguous"), F.raise_error(F.lit("bridge key maps to several athletes")).cast("string"))
        new["resolved_athlete_id"] = F.coalesce(clash, new["resolved_athlete_id"], F.raise_error(F.concat(
            F.lit("no canonical identity for "), F.col("r.athlete_id"))).cast("string"))
        new["athlete_name"] = F.coalesce(new["athlete_name"], F.raise_error(F.concat(
            F.lit("no canonical name for "), F.col("r.athlete_id"))).cast("string"))
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in stale], *[c.alias(n) for n, c in new.items()])


def same_year_records(results: DataFrame, athlete: str = "resolved_athlete_id") -> DataFrame:
    """Records of athlete-years that hold more than one record."""
    many = results.groupBy(athlete, "year").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return results.join(many, [athlete, "year"], "left_semi")


def athlete_year_counts(results: DataFrame, athlete: str = "resolved_athlete_id") -> DataFrame:
    return results.groupBy(athlete, "year").agg(F.count(F.lit(1)).alias("records"))


# ---- lookups ----------------------------------------------------------------------------------

def resolve_ids(requests: DataFrame, results: DataFrame, requested: str = "requested_id") -> DataFrame:
    """Current id for each requested id: itself if current, else the single id behind an old id.

    Outcome is CURRENT, ALIAS, AMBIGUOUS, UNKNOWN or EMPTY.
    """
    asked = requests.select(strip(F.col(requested)).alias("asked")).distinct()
    current = results.select(F.col("resolved_athlete_id").alias("asked")).where("asked IS NOT NULL").distinct()
    former = results.where("resolved_athlete_id IS NOT NULL").groupBy(F.col("athlete_id").alias("asked")).agg(
        F.min("resolved_athlete_id").alias("low"), F.max("resolved_athlete_id").alias("high"))
    found = asked.join(current.withColumn("is_current", F.lit(True)), "asked", "left").join(former, "asked", "left")
    outcome = (F.when(blank_to_null(F.col("asked")).isNull(), "EMPTY").when(F.col("is_current"), "CURRENT")
               .when(F.col("low").isNull(), "UNKNOWN").when(F.col("low") == F.col("high"), "ALIAS")
               .otherwise("AMBIGUOUS"))
    return found.select(
        F.col("asked").alias(requested), outcome.alias("outcome"),
        F.when(outcome == "CURRENT", F.col("asked")).when(outcome == "ALIAS", F.col("low")).alias("athlete"))


def _latest(results: DataFrame, athlete: str, n: int, tie: str) -> DataFrame:
    newest = Window.partitionBy(athlete).orderBy(
        F.col("year").desc(), F.col("competition").desc(), F.col(tie).desc())
    # the rank limit is also applied before the shuffle, so an athlete sends at most n rows per task
    return results.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def history(results: DataFrame, athlete_ids: Sequence[str] | None = None, before_year: int | None = None,
            limit: int | None = None, athlete: str = "resolved_athlete_id", tie: str = "seq") -> DataFrame:
    """Histories of the given athletes (or of all), optionally before a year, newest n only."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be greater than zero")
    rows = results.where(F.col(athlete).isNotNull())
    if athlete_ids is not None:
        rows = rows.where(F.col(athlete).isin(*athlete_ids))
    if before_year is not None:
        rows = rows.where(F.col("year") < int(before_year))
    return rows if limit is None else _latest(rows, athlete, limit, tie)


def ordered_history(rows: DataFrame, athlete: str = "resolved_athlete_id", tie: str = "seq") -> DataFrame:
    return rows.orderBy(athlete, F.col("year").asc_nulls_last(), F.col("competition").asc_nulls_last(), tie)


def latest_record(results: DataFrame, athlete: str = "resolved_athlete_id", tie: str = "seq") -> DataFrame:
    return _latest(results.where(F.col(athlete).isNotNull()), athlete, 1, tie)


def find_athletes(results: DataFrame, athlete: str = "resolved_athlete_id", tie: str = "seq") -> DataFrame:
    """Latest attributes, number of competitions and first and latest year per athlete."""
    shown = ("athlete_name", "athlete_id", "division", "equipment", "weight_class", "date_of_birth", "team",
             "identity_confidence")
    order = F.struct("year", "competition", tie)
    per = results.where(F.col(athlete).isNotNull()).groupBy(F.col(athlete).alias("athlete")).agg(
        F.max(F.struct(order.alias("o"), F.struct(*shown).alias("r"))).alias("last"),
        F.count(F.lit(1)).alias("competition_count"), F.min("year").alias("first_year"),
        F.max("year").alias("latest_year"))
    return per.select("athlete", *[F.col(f"last.r.{c}").alias(c) for c in shown],
                      "competition_count", "first_year", "latest_year")


def athlete_options(results: DataFrame, athlete: str = "resolved_athlete_id") -> DataFrame:
    """Distinct athletes with their first label in (name, id) order."""
    return results.where(F.col(athlete).isNotNull()).groupBy(F.col(athlete).alias("athlete")).agg(
        F.min("athlete_name").alias("athlete_name"))


def size_counts(results: DataFrame, athlete: str = "resolved_athlete_id") -> DataFrame:
    return results.agg(F.countDistinct(athlete).alias("athletes"), F.count(F.lit(1)).alias("records"))


# ---- filtered lists ---------------------------------------------------------------------------

def competition_results(results: DataFrame, *, division: str | None = None, weight_class: str | int | None = None,
                        equipment: str | None = None, competition: str | None = None, year: int | None = None,
                        before_year: int | None = None) -> DataFrame:
    """Rows that pass every given filter. Plain comparisons, so they reach the scan."""
    tests = []
    if division is not None:
        tests.append(F.trim("division") == division.strip())
    if weight_class is not None:
        tests.append(F.col("weight_class") == str(weight_class))
    if equipment is not None:
        tests.append(F.upper(F.trim("equipment")) == equipment.strip().upper())
    if competition is not None:
        tests.append(F.trim("competition") == competition.strip())
    if year is not None:
        tests.append(F.col("year") == int(year))
    if before_year is not None:
        tests.append(F.col("year") < int(before_year))
    for t in tests:
        results = results.where(t)
    return results


def in_list_order(results: DataFrame, tie: str = "seq", limit: int | None = None) -> DataFrame:
    """Newest year first, then meet, place, total and name; a limit runs as a distributed top-n."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be greater than zero")
    ranked = results.orderBy(
        F.col("year").desc_nulls_last(), F.col("competition").asc_nulls_last(), F.col("place").asc_nulls_last(),
        F.col("total").desc_nulls_last(), F.col("athlete_name").asc_nulls_last(), tie)
    return ranked if limit is None else ranked.limit(limit)


def performance_snapshot(latest: DataFrame) -> DataFrame:
    """Latest record as a planning snapshot, with the names of missing fields."""
    need = ("bodyweight", "best_squat", "best_bench", "best_deadlift", "total")
    absent = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in need]), lambda x: x.isNotNull())
    return latest.select("*", F.array_join(absent, ", ").alias("missing_fields"), (F.size(absent) == 0).alias("complete"))
