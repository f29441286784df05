"""Extracted rows to canonical results: manifest match, normalisation, build counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.functions.text import (
    athlete_id, blank_to_null, equipment_of, normal_name, strip, year_of,
)
from meetlake.schema import MEASURES, RESULT_SCHEMA


def file_stem(path: Column) -> Column:
    """Lower-case base name without its last extension."""
    base = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.lower(F.trim(F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")))


def manifest_index(manifest: DataFrame, position: str = "position") -> DataFrame:
    """One manifest entry per file stem.

    An entry filed as a .pdf of that name comes first (the last such entry wins), then any entry whose
    file name or local path has the stem (the first one wins). Entries without a file name are skipped.
    """
    named = manifest.where(blank_to_null(F.col("filename")).isNotNull())
    pdf = F.lower(F.trim("filename")).endswith(".pdf")
    ways = F.array(
        F.struct(file_stem(F.col("filename")).alias("stem"), F.when(pdf, F.lit(0)).otherwise(F.lit(1)).alias("rank")),
        F.struct(file_stem(F.col("local_path")).alias("stem"), F.lit(1).alias("rank")))
    entries = named.select(F.explode(ways).alias("way"), "competition", "year", position).where("way.stem IS NOT NULL")
    order = F.struct("way.rank", F.when(F.col("way.rank") == 0, -F.col(position)).otherwise(F.col(position)).alias("at"))
    return entries.groupBy(F.col("way.stem").alias("stem")).agg(
        F.min_by(F.struct("competition", "year"), order).alias("meta")).select("stem", "meta.*")


def with_metadata(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Attach meet name and year by file stem; both null for a source the manifest does not know."""
    meta = index.select(F.col("stem"), F.col("competition").alias("meet"), F.col("year").alias("meet_year"))
    return rows.withColumn("stem", file_stem(F.col("source_file"))).join(meta, "stem", "left").drop("stem")


def unknown_sources(sources: DataFrame, index: DataFrame) -> DataFrame:
    """Sources without a manifest entry."""
    return sources.withColumn("stem", file_stem(F.col("source_file"))).join(
        index.select("stem"), "stem", "left_anti").drop("stem")


def rejected_rows(rows: DataFrame) -> DataFrame:
    """Parsed rows that cannot become results, with the reason; empty when the strict path would pass."""
    reason = (F.when(F.col("meet").isNull(), "no manifest entry or meet name")
              .when(year_of(F.col("meet_year")).isNull(), "no year")
              .when(F.col("weight_class").isNull(), "no weight class")
              .when(F.col("division").isNull(), "no division")
              .when(blank_to_null(strip(F.col("athlete_name"))).isNull(), "no athlete name"))
    return rows.where(F.col("status") == "PARSED").withColumn("reason", reason).where("reason IS NOT NULL")


def canonical_results(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Canonical results of the PARSED rows, with source file and line number in front.

    In strict mode a row without meet, year, class, division or name fails the job; otherwise such rows stay
    out (see rejected_rows).
    """
    def need(c: Column, what: str, kind: str = "string") -> Column:
        if not strict:
            return c
        return F.coalesce(c, F.raise_error(F.concat(F.lit(f"missing {what} in "), F.col("source_file"))).cast(kind))

    name = normal_name(F.col("athlete_name"))
    columns = {
        "athlete_id": need(F.when(blank_to_null(strip(name)).isNotNull(), athlete_id(name)), "athlete name"), "athlete_name": name, "resolved_athlete_id": F.lit(None),
        "identity_confidence": F.lit("CANDIDATE"), "competition": need(strip(F.col("meet")), "meet name"),
        "year": need(year_of(F.col("meet_year")), "year", "int"), "division": need(strip(F.col("division")), "division"),
        "weight_class": need(strip(F.col("weight_class")), "weight class"), "equipment": equipment_of(F.col("meet")),
        "date_of_birth": F.col("date_of_birth"), "team": blank_to_null(strip(F.col("team"))),
        "lot": blank_to_null(strip(F.col("lot"))), **{m: F.col(m) for m in MEASURES}, "place": F.col("place"),
    }
    parsed = rows.where(F.col("status") == "PARSED")
    out = parsed.select("source_file", "line_no", *[
        columns[f.name].cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields])
    needed = ("competition", "year", "division", "weight_class", "athlete_id")
    return out if strict else out.dropna(subset=list(needed))


def build_counters(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """Sources, sources with parsed rows, incomplete and review rows, normalised results."""
    per_source = rows.groupBy("source_file").agg(
        F.count_if(F.col("status") == "PARSED").alias("parsed"),
        F.count_if(F.col("status") == "INCOMPLETE").alias("incomplete"),
        F.count_if(F.col("status") == "REVIEW").alias("review"))
    joined = sources.select("source_file").join(per_source, "source_file", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.agg(
        F.count(F.lit(1)).alias("source_count"), F.count_if(F.col("parsed") > 0).alias("parsed_source_count"),
        total("incomplete").alias("incomplete_count"), total("review").alias("review_count"),
        total("parsed").alias("normalized_count"))
