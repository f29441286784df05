import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meetlake.functions import numbers as N
from meetlake.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "z string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column).first()[0]


@pytest.mark.parametrize("token,value", [
    ("170", 170.0), ("170.5", 170.5), ("X170", -170.0), ("x170", -170.0), ("XX170", -170.0), ("-170", -170.0), ("X-5", 5.0),
    ("-", None), ("X", None), ("", None), ("TD", None), ("1e3", 1000.0), ("1_0", 10.0), ("nan", None), ("inf", None),
    ("5.", 5.0), (".5", 0.5), ("1.0d", None)])
def test_lift_number(spark, token, value):
    from meetlake.operators.sheet_rows import number
    assert one(spark, N.lift_number(F.col("t")), t=token) == value
    assert one(spark, F.expr(number("t")), t=token) == value


def test_names_and_ids(spark):
    name = "  ann \t  o'hara "
    assert one(spark, X.normal_name(F.col("n")), n=name) == "ANN O'HARA"
    digest = hashlib.sha256(b"ANN O'HARA").hexdigest()[:16]
    assert one(spark, X.athlete_id(F.col("n")), n=name) == f"ATH-{digest}"
    with_date = hashlib.sha256(b"ANN O'HARA|01-02-1990").hexdigest()[:16]
    assert one(spark, X.resolved_athlete_id(F.col("n"), F.col("d")), n=name, d=" 01-02-1990 ") == f"ATH-{with_date}"
    assert one(spark, X.resolved_athlete_id(F.col("n"), F.lit(None)), n=name) == f"ATH-{digest}"
    assert one(spark, X.identity_text(F.col("n")), n="  ") is None
    assert one(spark, X.optional_text(F.col("n")), n=" a  b ") == "A  B"


@pytest.mark.parametrize("text,year", [("2019", 2019), ("Season 2025-26", 2025), ("12019", None), ("in 1899, 1999", 1999), ("none", None)])
def test_year(spark, text, year):
    assert one(spark, X.year_of(F.col("t")), t=text) == year


@pytest.mark.parametrize("name,label", [
    ("National Classic Cup", "CLASSIC"), ("Equipped and Classic Cup", "EQUIPPED"), ("Open Cup", "UNKNOWN")])
def test_equipment(spark, name, label):
    assert one(spark, X.equipment_of(F.col("t")), t=name) == label


def test_labels(spark):
    assert one(spark, X.canonical_equipment(F.col("t")), t=" raw ") == "CLASSIC"
    assert one(spark, X.canonical_equipment(F.col("t")), t="other") == "OTHER"
    assert one(spark, X.canonical_division(F.col("t")), t="sub-junior") == "Sub Junior"
    assert one(spark, X.canonical_division(F.col("t")), t="Veterans") == "Veterans"
    assert one(spark, X.class_label(F.col("t")), t="Men 83 kg") == "83 kg"
    assert [one(spark, X.weight_class_of(F.col("b")), b=b) for b in (53.0, 53.1, 105.0, 120.0, 120.1)] == [
        "53", "59", "105", "120", "120+"]
    assert one(spark, X.class_index(F.col("b")), b=120.1) == 8


@pytest.mark.parametrize("category,number", [("Men 83 kg", 83), ("men 120+ KG", 120), ("Men 83+ kg", None), ("Men 84 kg", None), ("Women 57 kg", None)])
def test_category(spark, category, number):
    assert one(spark, X.category_class(F.col("t")), t=category) == number


def test_strict_labels_fail(spark):
    with pytest.raises(PySparkException):
        one(spark, X.checked_category(F.col("t")), t="Women 57 kg")
    with pytest.raises(PySparkException):
        one(spark, X.checked_tier(F.col("t")), t="Regional")
    assert one(spark, X.checked_tier(F.col("t")), t=" National ") == "National"


def test_plates(spark):
    assert [one(spark, f(F.col("v")), v=101.3) for f in (N.plate_floor, N.plate_ceil, N.plate_round)] == [100.0, 102.5, 102.5]
    assert one(spark, N.plate_ceil(F.col("v")), v=100.0) == 100.0
    assert one(spark, N.number_or(F.col("v"), 7.0), v="x") == 7.0


def test_catalogue(spark):
    from meetlake.functions import catalogue as K
    table = K.competition_catalogue(spark)
    assert table.count() == 5 and K.CATEGORIES[-1] == "Men 120+ kg"
    assert [r["name"] for r in K.select_competitions(table, "Nationals").collect()] == ["National Powerlifting Championship"]
    east = K.select_competitions(table, "Regional", "East India", 2027).collect()
    assert [(r["name"], r["tier"], r["year"]) for r in east] == [("East India Powerlifting Championship", "National", 2027)]
    assert K.select_competitions(table, "Regional", "India").count() == 0
