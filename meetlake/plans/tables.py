"""Binding of the star-schema tables to the canonical result table.

An order with lines becomes one filed result: the customer is the athlete, the return flag names the
lift, the line number the attempt. The SQL text states the same rules for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.functions.text import equipment_of, weight_class_of
from meetlake.schema import LIFTS, RESULT_SCHEMA

# fixed values: return flag of each lift
FLAG = {"squat": "A", "bench": "N", "deadlift": "R"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts, split as the scan splits it."""
    return table(spark, sf_dir, name)


def _line_facts() -> list[str]:
    """Per-order aggregates over the lines: best price of each lift and of each attempt."""
    out = ["avg(l_quantity) * 2 + 45 AS bodyweight", "min(l_linenumber) AS first_line"]
    for lift, flag in FLAG.items():
        out.append(f"max(CASE WHEN l_returnflag = '{flag}' THEN l_extendedprice END) AS {lift}_price")
        for k in (1, 2, 3):
            this = f"l_returnflag = '{flag}' AND (l_linenumber - 1) % 3 + 1 = {k}"
            out.append(f"max(CASE WHEN {this} THEN l_extendedprice END) AS {lift}_{k}_price")
            out.append(f"max(CASE WHEN {this} THEN l_discount END) AS {lift}_{k}_cut")
    return out


def _kg(price: str) -> str:
    return f"floor({price} / 500) * 2.5D"


def _result_columns() -> dict[str, str]:
    """Canonical columns of an order joined to its line facts; meet name and athlete are computed before."""
    name = "concat('CUSTOMER#', lpad(CAST(o_custkey AS string), 9, '0'))"
    born = ("concat_ws('-', lpad(CAST(o_custkey % 28 + 1 AS string), 2, '0'), lpad(CAST(o_custkey % 12 + 1 AS string), 2, '0'), "
            "CAST(o_custkey % 30 + 1970 + IF(o_orderkey % 8 = 1, 1, 0) AS string))")
    out = {
        "athlete_id": f"concat('ATH-', substring(sha2({name}, 256), 1, 16))", "athlete_name": name,
        "resolved_athlete_id": "CAST(NULL AS string)", "identity_confidence": "'CANDIDATE'",
        "competition": "meet", "year": "year(o_orderdate)",
        "division": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Open' WHEN '2-HIGH' THEN 'Junior' "
                    "WHEN '3-MEDIUM' THEN 'Sub Junior' WHEN '4-NOT SPECIFIED' THEN 'Master 1' ELSE 'Master 2' END",
        "date_of_birth": f"CASE WHEN o_orderkey % 4 <> 0 THEN {born} END",
        "team": "CASE o_custkey % 3 WHEN 0 THEN 'T N' WHEN 1 THEN 'J & K' ELSE 'KAR' END",
        "lot": "CAST(o_orderkey % 200 + 1 AS string)", "bodyweight": "bodyweight",
    }
    for lift in LIFTS:
        for k in (1, 2, 3):
            kg = _kg(f"{lift}_{k}_price")
            out[f"{lift}_{k}"] = f"CASE WHEN {lift}_{k}_cut >= 0.08D THEN 0D - {kg} ELSE {kg} END"
        out[f"best_{lift}"] = _kg(f"{lift}_price")
    summed = " + ".join(out[f"best_{lift}"] for lift in LIFTS)
    out["total"] = f"CASE o_orderstatus WHEN 'P' THEN {_kg('o_totalprice')} ELSE {summed} END"
    out["place"] = f"CASE WHEN ({out['total']}) IS NOT NULL THEN first_line END"
    return out


_MEET = ("concat(CASE o_orderkey % 3 WHEN 0 THEN 'State' WHEN 1 THEN 'National' ELSE 'International' END, "
         "CASE o_orderstatus WHEN 'F' THEN ' Classic Meet ' WHEN 'O' THEN ' Equipped Meet ' ELSE ' Meet ' END, "
         "year(o_orderdate), ' Q', quarter(o_orderdate))")


def meet_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines; ``seq`` is the filing order.

    Lines are reduced per order before they meet the orders, so both sides of the join have one row per
    key. The dates, customers and meets of large orders play no part in the partitioning.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    facts = lines.groupBy("l_orderkey").agg(*map(F.expr, _line_facts()))
    joined = facts.join(orders, F.expr("l_orderkey = o_orderkey")).withColumn("meet", F.expr(_MEET))
    columns = {n: F.expr(c) for n, c in _result_columns().items()} | {
        "equipment": equipment_of(F.col("meet")), "weight_class": weight_class_of(F.col("bodyweight"))}
    return joined.select(F.col("o_orderkey").alias("seq"), *[columns[n].alias(n) for n in RESULT_SCHEMA.names])


def _attempt_sql() -> str:
    outer = []
    for lift in LIFTS:
        outer.append(f"floor({lift}_price / 500) * 2.5 AS best_{lift}")
        for k in (1, 2, 3):
            outer.append(f"CASE WHEN {lift}_{k}_cut >= 0.08 THEN 0.0 - floor({lift}_{k}_price / 500) * 2.5 "
                         f"ELSE floor({lift}_{k}_price / 500) * 2.5 END AS {lift}_{k}")
    return ",\n    ".join(outer)


MEET_RESULTS_SQL = f"""
line_facts AS (
  SELECT l_orderkey, {", ".join(_line_facts())}
  FROM lineitem GROUP BY l_orderkey),
filed AS (
  SELECT o.*, f.*,
    'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS athlete_name,
    CASE o_orderkey % 3 WHEN 0 THEN 'State' WHEN 1 THEN 'National' ELSE 'International' END || ' '
      || CASE o_orderstatus WHEN 'F' THEN 'Classic ' WHEN 'O' THEN 'Equipped ' ELSE '' END
      || 'Meet ' || year(o_orderdate) || ' Q' || quarter(o_orderdate) AS competition,
    CASE o_orderstatus WHEN 'P' THEN floor(o_totalprice / 500) * 2.5
      ELSE floor(squat_price / 500) * 2.5 + floor(bench_price / 500) * 2.5
        + floor(deadlift_price / 500) * 2.5 END AS total
  FROM orders o JOIN line_facts f ON l_orderkey = o_orderkey),
meet_results AS (
  SELECT o_orderkey AS seq, 'ATH-' || substr(sha256(athlete_name), 1, 16) AS athlete_id, athlete_name,
    CAST(NULL AS VARCHAR) AS resolved_athlete_id, 'CANDIDATE' AS identity_confidence, competition,
    CAST(year(o_orderdate) AS INTEGER) AS year,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Open' WHEN '2-HIGH' THEN 'Junior' WHEN '3-MEDIUM' THEN 'Sub Junior'
      WHEN '4-NOT SPECIFIED' THEN 'Master 1' ELSE 'Master 2' END AS division,
    CASE WHEN bodyweight <= 53 THEN '53' WHEN bodyweight <= 59 THEN '59' WHEN bodyweight <= 66 THEN '66'
      WHEN bodyweight <= 74 THEN '74' WHEN bodyweight <= 83 THEN '83' WHEN bodyweight <= 93 THEN '93'
      WHEN bodyweight <= 105 THEN '105' WHEN bodyweight <= 120 THEN '120' ELSE '120+' END AS weight_class,
    CASE o_orderstatus WHEN 'F' THEN 'CLASSIC' WHEN 'O' THEN 'EQUIPPED' ELSE 'UNKNOWN' END AS equipment,
    CASE WHEN o_orderkey % 4 <> 0 THEN lpad(CAST(o_custkey % 28 + 1 AS VARCHAR), 2, '0') || '-'
      || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-'
      || (o_custkey % 30 + 1970 + CASE WHEN o_orderkey % 8 = 1 THEN 1 ELSE 0 END) END AS date_of_birth,
    CASE o_custkey % 3 WHEN 0 THEN 'T N' WHEN 1 THEN 'J & K' ELSE 'KAR' END AS team,
    CAST(o_orderkey % 200 + 1 AS VARCHAR) AS lot, bodyweight,
    {_attempt_sql()},
    total, CASE WHEN total IS NOT NULL THEN first_line END AS place
  FROM filed)"""


def refiled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results where the open division was filed twice: natural exact copies."""
    once = meet_results(spark, sf_dir).withColumn("copy", F.lit(0))
    again = once.where("division = 'Open'").withColumn("copy", F.lit(1))
    return once.unionByName(again).withColumn("seq", F.col("seq") * 2 + F.col("copy")).drop("copy")


REFILED_SQL = MEET_RESULTS_SQL + """,
refiled AS (
  SELECT * REPLACE (seq * 2 AS seq) FROM meet_results
  UNION ALL SELECT * REPLACE (seq * 2 + 1 AS seq) FROM meet_results WHERE division = 'Open')"""
