"""Number tokens, lift values, plate rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: a decimal literal with optional grouping underscores and exponent, and its failed form
_DECIMAL = r"[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?"
NUMBER = rf"^{_DECIMAL}$"
SIGNED_NUMBER = rf"^[xX]*{_DECIMAL}$"


def to_number(token: Column) -> Column:
    """Double value of a numeric token, null for anything else (NaN and infinity included)."""
    return F.when(token.rlike(NUMBER), F.regexp_replace(token, "_", "").try_cast("double"))


def lift_number(token: Column) -> Column:
    """Signed lift value: a leading X marks a failed attempt and turns the sign."""
    value = to_number(F.regexp_replace(token, "^[xX]+", ""))
    return F.when(token.rlike("^[xX]"), F.lit(0.0) - value).otherwise(value)


def place_number(token: Column) -> Column:
    return F.when(token.rlike(r"^\d+$"), token.try_cast("int"))


def best_of(*attempts: Column) -> Column:
    """Largest successful attempt; failed ones are negative, missing ones null."""
    return F.greatest(*[F.when(a >= 0, a) for a in attempts]) if len(attempts) > 1 else F.when(
        attempts[0] >= 0, attempts[0])


def failed_count(attempts: Sequence[Column]) -> Column:
    return sum(F.coalesce((a < 0).cast("int"), F.lit(0)) for a in attempts)


def non_negative_or_null(c: Column) -> Column:
    return c.isNull() | (c >= 0)


def bests_sum(squat: Column, bench: Column, deadlift: Column) -> Column:
    return squat + bench + deadlift


def total_differs(df_cols, tolerance: float | None = None) -> Column:
    """Stored total against the sum of bests; exact unless a tolerance is given. False when a part is missing."""
    squat, bench, deadlift, total = (F.col(c) if isinstance(c, str) else c for c in df_cols)
    expected = bests_sum(squat, bench, deadlift)
    differs = total != expected if tolerance is None else F.abs(expected - total) > tolerance
    return F.coalesce(differs, F.lit(False))


STEP = 2.5  # kg, smallest plate change


def plate_floor(c: Column) -> Column:
    return F.floor((c + 1e-9) / STEP) * STEP


def plate_ceil(c: Column) -> Column:
    return F.ceil((c - 1e-9) / STEP) * STEP


def plate_round(c: Column) -> Column:
    return F.floor(c / STEP + 0.5) * STEP


def number_or(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def steady(c: Column, digits: int = 4) -> Column:
    """Rounding that does not hang on the last bit of an average: used for report columns."""
    scale = float(10 ** digits)
    return F.floor(c * scale + (0.5 + 1e-4)) / scale
