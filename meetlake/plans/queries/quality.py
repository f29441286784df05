"""Queries over data quality, duplicates, identity and descriptive tables."""

from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.functions.numbers import steady
from meetlake.operators import duplicates as D
from meetlake.operators import explore as E
from meetlake.operators import identity as I
from meetlake.operators import quality as Q
from meetlake.plans.registry import query
from meetlake.plans.tables import MEET_RESULTS_SQL, REFILED_SQL, meet_results, refiled_results, table
from meetlake.schema import ATTEMPTS, BESTS, LIFTS, MEASURES, RESULT_KEY, RESULT_SCHEMA
from meetlake.session import pinned

WITH = f"WITH {MEET_RESULTS_SQL}"
REFILED = f"WITH {REFILED_SQL}"
R4 = "floor({0} * 1e4 + 0.5001) / 1e4"


def _each(names, text, glue=", "):
    return glue.join(text.format(n) for n in names)


# ---- profile ----------------------------------------------------------------------------------

_LIFT_COUNTS = ", ".join(
    f"count_if(best_{x} IS NULL) AS {x}_missing, count(best_{x}) AS {x}_valid, "
    f"count_if({x}_1 < 0) + count_if({x}_2 < 0) + count_if({x}_3 < 0) AS {x}_failed_attempts" for x in LIFTS)


@query("profile", f"""{WITH}
SELECT count(*) AS total_records, count(DISTINCT athlete_id) AS unique_athletes,
  count(DISTINCT competition) AS competitions, count(DISTINCT year) AS years,
  count(DISTINCT division) AS divisions, count(DISTINCT weight_class) AS weight_classes,
  count_if(equipment = 'CLASSIC') AS equipment_classic, count_if(equipment = 'EQUIPPED') AS equipment_equipped,
  count_if(equipment = 'UNKNOWN') AS equipment_unknown, {_LIFT_COUNTS},
  count_if(total IS NULL) AS total_missing, count(total) AS total_valid FROM meet_results""")
def profile(spark, d):
    return Q.dataset_profile(meet_results(spark, d))


@query("statistics", f"{WITH} " + " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS key, count(*) AS records FROM meet_results GROUP BY {c}"
    for c in Q.HISTOGRAMS))
def statistics(spark, d):
    return Q.histograms(meet_results(spark, d))


@query("numeric_statistics", f"{WITH} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS count, min({c}) AS minimum, max({c}) AS maximum, "
    f"{R4.format(f'avg({c})')} AS average FROM meet_results" for c in Q.REQUIRED_VALUES))
def numeric_statistics(spark, d):
    return Q.numeric_statistics(meet_results(spark, d)).withColumn("average", steady(F.col("average")))


@query("athletes_by_count", f"""{WITH}
SELECT records, count(*) AS athletes FROM (SELECT count(*) AS records FROM meet_results GROUP BY athlete_id)
GROUP BY records""")
def athletes_by_count(spark, d):
    return Q.athletes_by_count(meet_results(spark, d))


@query("equipment_audit", f"""{WITH}
SELECT competition, year, count_if(equipment = 'CLASSIC') AS classic, count_if(equipment = 'EQUIPPED') AS equipped,
  count_if(equipment = 'UNKNOWN') AS unknown, count(*) AS total FROM meet_results GROUP BY competition, year""")
def equipment_audit(spark, d):
    return Q.equipment_audit(meet_results(spark, d))


@query("equipment_totals", f"""{WITH}
SELECT count(*) AS total_records, count_if(equipment = 'CLASSIC') AS classic_records,
  count_if(equipment = 'EQUIPPED') AS equipped_records, count_if(equipment = 'UNKNOWN') AS unknown_records,
  count(DISTINCT CASE WHEN equipment = 'UNKNOWN' THEN competition || '|' || year END) AS competitions_with_unknown
FROM meet_results""")
def equipment_totals(spark, d):
    return Q.equipment_totals(Q.equipment_audit(meet_results(spark, d)))


@query("unknown_equipment", f"{WITH} SELECT seq, competition, year FROM meet_results WHERE equipment = 'UNKNOWN'")
def unknown_equipment(spark, d):
    return Q.unknown_equipment(meet_results(spark, d)).select("seq", "competition", "year")


_ISSUES = " UNION ALL ".join(
    [f"SELECT athlete_id, competition, year, '{c}' AS field, 'MISSING_VALUE' AS issue_type, {c} AS value, "
     f"'{c} is missing' AS message FROM meet_results WHERE {c} IS NULL" for c in Q.REQUIRED_VALUES]
    + [f"SELECT athlete_id, competition, year, '{c}', 'INVALID_VALUE', {c}, '{c} cannot be negative' "
       f"FROM meet_results WHERE {c} < 0" for c in MEASURES]
    + ["SELECT athlete_id, competition, year, 'total', 'TOTAL_MISMATCH', total, "
       "'Total does not equal best squat + best bench + best deadlift' FROM meet_results "
       "WHERE best_squat + best_bench + best_deadlift <> total"])


@query("integrity_issues", f"{WITH} {_ISSUES}")
def integrity_issues(spark, d):
    return Q.integrity_issues(meet_results(spark, d))


_SUMMARY = """count(DISTINCT athlete_id || '|' || competition || '|' || year) AS records_with_issues,
  count(*) AS total_issues, count_if(issue_type = 'MISSING_VALUE') AS missing_value_issues,
  count_if(issue_type = 'INVALID_VALUE') AS invalid_value_issues,
  count_if(issue_type = 'TOTAL_MISMATCH') AS total_mismatch_issues"""


@query("integrity_summary", f"""{WITH}, issues AS ({_ISSUES})
SELECT (SELECT count(*) FROM meet_results) AS total_records, {_SUMMARY} FROM issues""")
def integrity_summary(spark, d):
    return Q.integrity_summary(meet_results(spark, d))


@query("quality_report", f"""{WITH}, issues AS ({_ISSUES})
SELECT (SELECT count(*) FROM meet_results) AS total_records,
  (SELECT count(*) FROM meet_results WHERE equipment = 'CLASSIC') AS classic,
  (SELECT count(*) FROM meet_results WHERE equipment = 'EQUIPPED') AS equipped,
  (SELECT count(*) FROM meet_results WHERE equipment = 'UNKNOWN') AS unknown, {_SUMMARY} FROM issues""")
def quality_report(spark, d):
    return Q.quality_report(meet_results(spark, d)).select("dataset.*", "equipment.*", "integrity.*")


# ---- duplicates -------------------------------------------------------------------------------

_KEY = ", ".join(RESULT_KEY)


@query("duplicate_groups", f"""{REFILED}
SELECT {_KEY}, count(*) AS records, min(seq) AS first_record, max(seq) AS last_record
FROM refiled GROUP BY ALL HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    return D.duplicate_groups(refiled_results(spark, d))


@query("duplicate_members", f"""{REFILED}
SELECT seq, min(seq) OVER (PARTITION BY {_KEY}) AS first_record FROM refiled
QUALIFY count(*) OVER (PARTITION BY {_KEY}) > 1""")
def duplicate_members(spark, d):
    return D.duplicate_members(refiled_results(spark, d)).select("seq", "first_record")


@query("dedup_report", f"""{REFILED}, sizes AS (SELECT count(*) AS n FROM refiled GROUP BY {_KEY})
SELECT CAST(sum(n) AS BIGINT) AS total_records, count(*) AS unique_records,
  CAST(sum(n - 1) AS BIGINT) AS duplicate_records, count_if(n > 1) AS duplicate_groups FROM sizes""")
def dedup_report(spark, d):
    return D.duplicate_report(refiled_results(spark, d))


@query("deduplicated", f"""{REFILED}
SELECT seq, {_KEY} FROM refiled QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY seq) = 1""")
def deduplicated(spark, d):
    return D.deduplicate(refiled_results(spark, d)).select("seq", *RESULT_KEY)


# ---- identity ---------------------------------------------------------------------------------

@query("athlete_ids", "SELECT c_custkey, upper(trim(c_name)) AS athlete_name, "
       "'ATH-' || substr(sha256(upper(trim(c_name))), 1, 16) AS athlete_id FROM customer")
def athlete_ids(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", X.normal_name(F.col("c_name")).alias("athlete_name"),
        X.athlete_id(F.col("c_name")).alias("athlete_id"))


@query("resolved_ids", f"""{WITH}
SELECT seq, 'ATH-' || substr(sha256(CASE WHEN date_of_birth IS NULL THEN athlete_name
    ELSE athlete_name || '|' || date_of_birth END), 1, 16) AS resolved_athlete_id,
  CASE WHEN date_of_birth IS NULL THEN 'CANDIDATE' ELSE 'HIGH' END AS identity_confidence FROM meet_results""")
def resolved_ids(spark, d):
    name, born = F.col("athlete_name"), F.col("date_of_birth")
    return meet_results(spark, d).select("seq", X.resolved_athlete_id(name, born).alias("resolved_athlete_id"),
                                         X.resolved_confidence(born).alias("identity_confidence"))


_CONTEXT = "athlete_id, year, competition, division, weight_class, equipment, bodyweight"


@query("identity_collisions", f"""{WITH}, contexts AS (SELECT DISTINCT {_CONTEXT} FROM meet_results)
SELECT *, count(*) OVER (PARTITION BY athlete_id) AS contexts FROM contexts
QUALIFY count(*) OVER (PARTITION BY athlete_id) > 1""")
def identity_collisions(spark, d):
    return I.identity_collisions(meet_results(spark, d))


@query("same_meet_collisions", f"""{WITH}
SELECT athlete_id, year, competition, count(*) AS records,
  count(DISTINCT (division, weight_class, equipment, bodyweight)) AS contexts
FROM meet_results GROUP BY athlete_id, year, competition HAVING count(*) > 1""")
def same_meet_collisions(spark, d):
    return I.same_meet_collisions(meet_results(spark, d))


@query("collision_statistics", f"""{WITH}
SELECT (SELECT count(DISTINCT athlete_id) FROM meet_results) AS athlete_ids,
  (SELECT count(*) FROM (SELECT athlete_id FROM (SELECT DISTINCT {_CONTEXT} FROM meet_results)
    GROUP BY athlete_id HAVING count(*) > 1)) AS candidate_collision_ids,
  (SELECT count(*) FROM (SELECT 1 FROM meet_results GROUP BY athlete_id, year, competition
    HAVING count(*) > 1)) AS same_competition_collision_groups""")
def collision_statistics(spark, d):
    return I.collision_statistics(meet_results(spark, d))


_PAIRS_SQL = """
pairs AS (
  SELECT a.athlete_id, a.year, a.competition,
    CASE WHEN a.date_of_birth <> b.date_of_birth THEN 'different_date_of_birth'
      WHEN a.date_of_birth = b.date_of_birth THEN 'same_date_of_birth'
      WHEN a.weight_class <> b.weight_class THEN 'different_weight_class_without_dob'
      ELSE 'insufficient_identity_metadata' END AS reason
  FROM meet_results a JOIN meet_results b USING (athlete_id, year, competition) WHERE a.seq < b.seq),
verdicts AS (
  SELECT athlete_id, year, competition, CASE WHEN bool_and(reason = 'same_date_of_birth') THEN 'SAME'
      WHEN bool_or(reason LIKE 'different%') THEN 'SPLIT' ELSE 'UNRESOLVED' END AS classification,
    count_if(reason = 'same_date_of_birth') AS same_date_of_birth,
    count_if(reason = 'different_date_of_birth') AS different_date_of_birth,
    count_if(reason = 'different_weight_class_without_dob') AS different_weight_class_without_dob,
    count_if(reason = 'insufficient_identity_metadata') AS insufficient_identity_metadata
  FROM pairs GROUP BY athlete_id, year, competition),
groups AS (
  SELECT v.*, n.records FROM verdicts v JOIN (SELECT athlete_id, year, competition, count(*) AS records
    FROM meet_results GROUP BY ALL) n USING (athlete_id, year, competition))"""
_REASONS = ("same_date_of_birth", "different_date_of_birth", "different_weight_class_without_dob",
            "insufficient_identity_metadata")


def identity_fields(spark, d):
    """What identity resolution reads of the results, pinned because groups and rows both come from it."""
    return pinned(meet_results(spark, d).select("seq", *I.GROUP, *I.ATTRIBUTES))


@query("resolve_groups", f"{WITH}, {_PAIRS_SQL} SELECT athlete_id, year, competition, records, classification, "
       f"{', '.join(_REASONS)} FROM groups")
def resolve_groups(spark, d):
    groups = I.resolve_groups(identity_fields(spark, d))
    return groups.withColumns({r: F.col(r).cast("bigint") for r in _REASONS})


@query("group_attributes", f"{WITH}, {_PAIRS_SQL} " + " UNION ".join(
    f"SELECT athlete_id, year, competition, '{a}' AS attribute, CAST({a} AS VARCHAR) AS value "
    f"FROM meet_results SEMI JOIN groups USING (athlete_id, year, competition) WHERE {a} IS NOT NULL"
    for a in ("date_of_birth", "team", "division", "weight_class", "equipment")))
def group_attributes(spark, d):
    return I.group_attributes(identity_fields(spark, d)).where("attribute <> 'bodyweight'")


@query("group_bodyweights", f"""{WITH}, {_PAIRS_SQL}
SELECT DISTINCT athlete_id, year, competition, 'bodyweight' AS attribute,
  CAST(CAST({R4.format("bodyweight")} AS DECIMAL(18, 4)) AS VARCHAR) AS value
FROM meet_results SEMI JOIN groups USING (athlete_id, year, competition) WHERE bodyweight IS NOT NULL""")
def group_bodyweights(spark, d):
    """The attribute that group_attributes leaves out, as text of four decimals that both engines share."""
    weight = F.floor(F.col("bodyweight") * F.lit(1e4) + F.lit(0.5001)) / F.lit(1e4)
    rows = identity_fields(spark, d).withColumn("bodyweight", weight.cast("decimal(18,4)"))
    return I.group_attributes(rows).where("attribute = 'bodyweight'")


_APPLIED_SQL = f"""{_PAIRS_SQL},
applied AS (
  SELECT m.* EXCLUDE (resolved_athlete_id, identity_confidence),
    CASE WHEN classification = 'UNRESOLVED' THEN NULL
      WHEN date_of_birth IS NOT NULL THEN 'ATH-' || substr(sha256(athlete_name || '|' || date_of_birth), 1, 16)
      ELSE m.athlete_id END AS resolved_athlete_id,
    CASE WHEN classification = 'UNRESOLVED' THEN 'UNRESOLVED' WHEN date_of_birth IS NULL THEN 'CANDIDATE'
      WHEN classification = 'SAME' THEN 'RESOLVED_SAME' WHEN classification = 'SPLIT' THEN 'RESOLVED_SPLIT'
      ELSE 'HIGH' END AS identity_confidence
  FROM meet_results m LEFT JOIN groups g USING (athlete_id, year, competition))"""


def applied(spark, d):
    """Resolved results; the results are read three times on the way, so they are pinned first."""
    results = pinned(meet_results(spark, d))
    return I.apply_resolution(results, I.resolve_groups(results))


@query("apply_resolution", f"{WITH}, {_APPLIED_SQL} "
       "SELECT seq, athlete_id, resolved_athlete_id, identity_confidence FROM applied")
def apply_resolution(spark, d):
    return applied(spark, d).select("seq", "athlete_id", "resolved_athlete_id", "identity_confidence")


@query("resolution_summary", f"""{WITH}, {_PAIRS_SQL}
SELECT classification, count(*) AS collision_groups, CAST(sum(records) AS BIGINT) AS records
FROM groups GROUP BY classification""")
def resolution_summary(spark, d):
    return I.resolution_summary(I.resolve_groups(identity_fields(spark, d)))


@query("resolution_counters", f"""{WITH}, {_APPLIED_SQL}
SELECT count(*) AS total, count(DISTINCT resolved_athlete_id) AS unique,
  count_if(identity_confidence = 'HIGH') AS high, count_if(identity_confidence = 'RESOLVED_SAME') AS same,
  count_if(identity_confidence = 'RESOLVED_SPLIT') AS split, count_if(identity_confidence = 'CANDIDATE') AS candidate,
  count_if(identity_confidence = 'UNRESOLVED') AS unresolved FROM applied""")
def resolution_counters(spark, d):
    return I.resolution_counters(applied(spark, d))


_AUDIT_KEY = ", ".join(Q.AUDIT_KEY)


@query("final_audit", f"""{WITH}, {_APPLIED_SQL}, sizes AS (SELECT count(*) AS n FROM applied GROUP BY {_AUDIT_KEY}),
counted AS (
SELECT count(*) AS total_records, {_each(Q.AUDIT_REQUIRED, "count_if({0} IS NULL) AS missing_{0}")},
  {", ".join(f"count_if(identity_confidence = '{k}') AS confidence_{k.lower()}" for k in Q.CONFIDENCES)},
  CAST(0 AS BIGINT) AS invalid_numerics, {_each(ATTEMPTS, "count_if({0} = 0)", " + ")} AS zero_attempts,
  count_if(abs(best_squat + best_bench + best_deadlift - total) > 0.01) AS total_mismatches,
  (SELECT count_if(n > 1) FROM sizes) AS duplicate_groups,
  CAST((SELECT coalesce(sum(n), 0) FROM sizes WHERE n > 1) AS BIGINT) AS records_in_duplicate_groups FROM applied)
SELECT *, CASE WHEN missing_resolved_athlete_id + total_mismatches + duplicate_groups > 0
  THEN 'FAIL' ELSE 'PASS' END AS result FROM counted""")
def final_audit(spark, d):
    return Q.final_audit(applied(spark, d))


@query("final_audit_text", f"""{WITH}, {_APPLIED_SQL}
SELECT count(*) AS total_records, count_if(seq % 7 = 0 AND bodyweight IS NOT NULL) + count_if(seq % 5 = 0 AND squat_1 IS NOT NULL)
    AS invalid_numerics,
  {" + ".join(f"count_if({a} = 0{' AND seq % 5 <> 0' if a == 'squat_1' else ''})" for a in ATTEMPTS)} AS zero_attempts,
  count_if(abs(best_squat + best_bench + best_deadlift - total) > 0.01) AS total_mismatches, 'FAIL' AS result FROM applied""")
def final_audit_text(spark, d):
    """Results as text, with words in place of some numbers."""
    rows = applied(spark, d)
    text = {m: F.col(m).cast("string") for m in MEASURES}
    text["bodyweight"] = F.when((F.col("seq") % 7 == 0) & F.col("bodyweight").isNotNull(), F.lit("sixty")).otherwise(text["bodyweight"])
    text["squat_1"] = F.when((F.col("seq") % 5 == 0) & F.col("squat_1").isNotNull(), F.lit("n/a")).otherwise(text["squat_1"])
    return Q.final_audit(rows.withColumns(text)).select(
        "total_records", "invalid_numerics", "zero_attempts", "total_mismatches", "result")


# ---- descriptive tables -----------------------------------------------------------------------

@query("overview", f"""{WITH}
SELECT count(*) AS records, CAST({len(RESULT_SCHEMA) + 1} AS INTEGER) AS columns, count(DISTINCT athlete_id) AS athletes,
  count(DISTINCT competition) AS competitions, count(DISTINCT year) AS years, min(year) AS min_year,
  max(year) AS max_year FROM meet_results""")
def overview(spark, d):
    return E.overview(meet_results(spark, d))


@query("career_summary", f"""{WITH}
SELECT athlete_id, count(*) AS records, count(DISTINCT competition) AS competitions, min(year) AS first_year,
  max(year) AS last_year, {_each(BESTS, "max({0}) AS {0}")}, max(total) AS best_total,
  {R4.format('avg(bodyweight)')} AS mean_bodyweight, max(year) - min(year) AS career_span_years
FROM meet_results GROUP BY athlete_id""")
def career_summary(spark, d):
    return E.career_summary(meet_results(spark, d), "athlete_id").withColumn(
        "mean_bodyweight", steady(F.col("mean_bodyweight")))


@query("frequency_share", f"""{WITH}
SELECT coalesce(date_of_birth, '<MISSING>') AS value, count(*) AS records,
  round_even(count(*) / (SELECT count(*) FROM meet_results) * 100, 2) AS percent FROM meet_results GROUP BY 1""")
def frequency_share(spark, d):
    return E.frequency_share(meet_results(spark, d), "date_of_birth")


_PROFILED = ("athlete_id", "competition", "year", "division", "team", "date_of_birth", *BESTS, "total", "place")


@query("column_profile", f"{WITH} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS non_null, count(*) - count({c}) AS missing, "
    f"count(DISTINCT {c}) AS \"unique\", round_even((count(*) - count({c})) / count(*) * 100, 2) AS missing_percent "
    "FROM meet_results" for c in _PROFILED))
def column_profile(spark, d):
    return E.column_profile(meet_results(spark, d).select(*_PROFILED)).select(
        "field", "non_null", "missing", "unique", "missing_percent")


@query("describe", f"{WITH} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS count, {R4.format(f'avg({c})')} AS mean, "
    f"{R4.format(f'stddev_samp({c})')} AS std, min({c}) AS min, max({c}) AS max, "
    + ", ".join(f"{R4.format(f'quantile_cont({c}, {q / 100})')} AS p{q}" for q in (25, 50, 75))
    + " FROM meet_results" for c in E.NUMERIC))
def describe(spark, d):
    return E.describe(meet_results(spark, d)).withColumns(
        {c: steady(F.col(c)) for c in ("mean", "std", "p25", "p50", "p75")})


@query("correlation", f"{WITH} " + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {R4.format(f'corr({a}, {b})')} AS correlation FROM meet_results"
    for i, a in enumerate(E.NUMERIC) for b in E.NUMERIC[i:]))
def correlation(spark, d):
    return E.correlation(meet_results(spark, d)).withColumn("correlation", steady(F.col("correlation")))


@query("iqr_outliers", f"{WITH} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count_if({c} < q1 - (q3 - q1) * 1.5 OR {c} > q3 + (q3 - q1) * 1.5) AS outliers, "
    f"round_even(count_if({c} < q1 - (q3 - q1) * 1.5 OR {c} > q3 + (q3 - q1) * 1.5) / count(*) * 100, 2) AS percent "
    f"FROM meet_results, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM meet_results)"
    for c in E.NUMERIC))
def iqr_outliers(spark, d):
    return E.iqr_outliers(meet_results(spark, d))


@query("zero_attempts", f"{WITH} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count_if({c} = 0) AS zero_count, count_if({c} IS NULL) AS missing_count FROM meet_results"
    for c in ATTEMPTS))
def zero_attempts(spark, d):
    return E.zero_attempts(meet_results(spark, d))


_ROW = ", ".join(c for c in RESULT_SCHEMA.names)


@query("eda_readiness", f"""{REFILED}, rows AS (SELECT {_ROW}, count(*) AS n FROM refiled GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS records,
  {_each(("resolved_athlete_id", "competition", "year", "division", "weight_class", "equipment"),
         "CAST(coalesce(sum(CASE WHEN {0} IS NULL THEN n END), 0) AS BIGINT) AS missing_{0}")},
  CAST(sum(n - 1) AS BIGINT) AS exact_duplicate_rows,
  CAST(coalesce(sum(CASE WHEN {_each(ATTEMPTS, "{0} = 0", " OR ")} THEN n END), 0) AS BIGINT)
    AS records_with_zero_attempt FROM rows""")
def eda_readiness(spark, d):
    return E.eda_readiness(refiled_results(spark, d), RESULT_SCHEMA.names)


@query("total_check", f"""{WITH}
SELECT seq, total, best_squat + best_bench + best_deadlift AS calculated_total,
  best_squat + best_bench + best_deadlift - total AS difference FROM meet_results
WHERE abs(best_squat + best_bench + best_deadlift - total) > 0.01""")
def total_check(spark, d):
    return E.total_check(meet_results(spark, d)).select("seq", "total", "calculated_total", "difference")


@query("duplicate_keys", f"""{WITH}
SELECT athlete_id, competition, year, count(*) AS records FROM meet_results
GROUP BY athlete_id, competition, year HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return E.duplicate_keys(meet_results(spark, d), ("athlete_id", "competition", "year"))
