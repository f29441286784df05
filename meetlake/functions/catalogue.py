"""The planner's choices: classes, divisions, regions, years and the supported meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.functions.text import CLASS_LIMITS, OPEN_CLASS

WEIGHT_CLASSES = tuple(f"{k} kg" for k in (*CLASS_LIMITS, OPEN_CLASS))
CATEGORIES = tuple(f"Men {c}" for c in WEIGHT_CLASSES)
# fixed values: divisions, meet families and regions
DIVISIONS = ("Sub Junior", "Junior", "Open", "Master 1", "Master 2", "Master 3", "Master 4")
COMPETITION_TYPES = ("Nationals", "Regional")
REGIONS = ("India", "East India", "West India", "North India", "South India")


def competition_catalogue(spark: SparkSession) -> DataFrame:
    """One national meet and one meet per region, all at national tier."""
    regions = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in REGIONS])).alias("region"))
    national = F.col("region") == REGIONS[0]
    return regions.select(
        F.concat(F.when(national, "National").otherwise(F.col("region")), F.lit(" Powerlifting Championship")).alias("name"),
        F.when(national, COMPETITION_TYPES[0]).otherwise(COMPETITION_TYPES[1]).alias("competition_type"),
        "region", F.lit("National").alias("tier"))


def select_competitions(catalogue: DataFrame, competition_type: str | None = None, region: str | None = None,
                        year: int | None = None) -> DataFrame:
    """Catalogue rows of a type and region; a planning year is added as a column."""
    if competition_type is not None:
        catalogue = catalogue.where(F.col("competition_type") == competition_type)
    if region is not None:
        catalogue = catalogue.where(F.col("region") == region)
    return catalogue if year is None else catalogue.withColumn("year", F.lit(int(year)))
