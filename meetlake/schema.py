"""Column contracts of the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LIFTS = ("squat", "bench", "deadlift")
ATTEMPTS = tuple(f"{lift}_{k}" for lift in LIFTS for k in (1, 2, 3))
BESTS = tuple(f"best_{lift}" for lift in LIFTS)
TARGETS = (*BESTS, "total")
# squat_1..3, best_squat, bench_1..3, best_bench, ...
LIFT_BLOCK = tuple(c for lift in LIFTS for c in (*(f"{lift}_{k}" for k in (1, 2, 3)), f"best_{lift}"))
MEASURES = ("bodyweight", *LIFT_BLOCK, "total")

_TEXT_REQUIRED = ("athlete_id", "competition", "division", "weight_class", "equipment", "identity_confidence")
_ORDER = (
    "athlete_id", "athlete_name", "resolved_athlete_id", "identity_confidence", "competition", "year",
    "division", "weight_class", "equipment", "date_of_birth", "team", "lot", *MEASURES, "place",
)


def _field(name: str) -> T.StructField:
    if name in ("year", "place"):
        return T.StructField(name, T.IntegerType(), name == "place")
    if name in MEASURES:
        return T.StructField(name, T.DoubleType(), True)
    return T.StructField(name, T.StringType(), name not in _TEXT_REQUIRED)


RESULT_SCHEMA = T.StructType([_field(n) for n in _ORDER])

# The CSV sink writes these columns, in this order; name, birth date, team, lot and the resolved id stay out.
CSV_COLUMNS = (
    "athlete_id", "competition", "year", "division", "weight_class", "equipment", *MEASURES, "place",
)
# Two rows that agree on all of these are the same filed result.
RESULT_KEY = CSV_COLUMNS

MANIFEST_SCHEMA = T.StructType([
    T.StructField(n, T.StringType(), True)
    for n in ("filename", "local_path", "year", "competition", "men_url", "status")
])

# fixed values: allowed labels
EQUIPMENT = ("CLASSIC", "EQUIPPED", "UNKNOWN")

CONTEXT_FEATURES = ("year", "division", "weight_class", "equipment")
HISTORY_FEATURES = (
    "previous_year_count", "previous_year", "years_since_previous", "previous_total", "previous_squat",
    "previous_bench", "previous_deadlift", "previous_bodyweight", "historical_mean_total",
    "historical_max_total", "historical_min_total", "historical_std_total", "historical_max_squat",
    "historical_max_bench", "historical_max_deadlift", "historical_mean_bodyweight",
    "previous_total_change", "previous_total_change_pct",
)
PRODUCTION_FEATURES = (*CONTEXT_FEATURES, *HISTORY_FEATURES)


def require_columns(df: DataFrame, needed) -> DataFrame:
    """Fail at plan time, before any data is read, when a column is absent."""
    absent = sorted(set(needed) - set(df.columns))
    if absent:
        raise ValueError("missing columns: " + ", ".join(absent))
    return df


def forbid_columns(features, forbidden) -> None:
    """Leakage guard: no feature may carry a name from the forbidden set."""
    overlap = sorted(set(features) & set(forbidden))
    if overlap:
        raise ValueError("columns not allowed as features: " + ", ".join(overlap))
