"""Queries over the application table."""

from pyspark.sql import functions as F

from meetlake.operators import service as S
from meetlake.plans.queries.quality import _APPLIED_SQL, WITH, applied
from meetlake.plans.registry import query
from meetlake.plans.tables import meet_results, table

_KEYS = "athlete_id, year, competition, date_of_birth"
_BRIDGE_SQL = f"""
bridge AS (
  SELECT {_KEYS}, min(resolved_athlete_id) AS resolved_athlete_id, min(athlete_name) AS athlete_name,
    count(DISTINCT resolved_athlete_id) > 1 AS ambiguous FROM applied GROUP BY {_KEYS})"""


@query("identity_bridge", f"""{WITH}, {_APPLIED_SQL}, {_BRIDGE_SQL}
SELECT m.seq, b.resolved_athlete_id, b.athlete_name FROM meet_results m LEFT JOIN bridge b
  ON m.athlete_id = b.athlete_id AND m.year = b.year AND m.competition = b.competition
  AND m.date_of_birth IS NOT DISTINCT FROM b.date_of_birth""")
def identity_bridge(spark, d):
    rows = S.attach_identity(meet_results(spark, d), applied(spark, d), strict=False)
    return rows.select("seq", "resolved_athlete_id", "athlete_name")


@query("bridge_unmatched", f"""{WITH}
SELECT DISTINCT {_KEYS} FROM meet_results m WHERE NOT EXISTS (SELECT 1 FROM meet_results c
  WHERE c.division <> 'Open' AND c.athlete_id = m.athlete_id AND c.year = m.year AND c.competition = m.competition
  AND c.date_of_birth IS NOT DISTINCT FROM m.date_of_birth)""")
def bridge_unmatched(spark, d):
    results = meet_results(spark, d)
    return S.bridge_unmatched(results, results.where("division <> 'Open'"))


@query("ambiguous_keys", f"""{WITH}, ids AS (
SELECT {_KEYS}, CASE WHEN division = 'Open' THEN 'o' || athlete_id ELSE athlete_id END AS rid FROM meet_results)
SELECT {_KEYS} FROM ids GROUP BY {_KEYS} HAVING count(DISTINCT rid) > 1""")
def ambiguous_keys(spark, d):
    marked = F.when(F.col("division") == "Open", F.concat(F.lit("o"), F.col("athlete_id"))).otherwise(F.col("athlete_id"))
    return S.ambiguous_keys(meet_results(spark, d).withColumn("resolved_athlete_id", marked))


@query("same_year_records", f"""{WITH}
SELECT seq, athlete_id, year FROM meet_results QUALIFY count(*) OVER (PARTITION BY athlete_id, year) > 1""")
def same_year_records(spark, d):
    return S.same_year_records(meet_results(spark, d), "athlete_id").select("seq", "athlete_id", "year")


@query("athlete_year_counts", f"{WITH} SELECT athlete_id, year, count(*) AS records FROM meet_results GROUP BY 1, 2")
def athlete_year_counts(spark, d):
    return S.athlete_year_counts(meet_results(spark, d), "athlete_id")


@query("history_before", f"{WITH} SELECT seq, athlete_id, year, competition, total FROM meet_results WHERE year < 1998")
def history_before(spark, d):
    rows = S.history(meet_results(spark, d), before_year=1998, athlete="athlete_id")
    return rows.select("seq", "athlete_id", "year", "competition", "total")


@query("history_last_n", f"""{WITH}
SELECT seq, athlete_id, year, competition, total FROM meet_results
QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY year DESC, competition DESC, seq DESC) <= 3""")
def history_last_n(spark, d):
    rows = S.history(meet_results(spark, d), limit=3, athlete="athlete_id")
    return rows.select("seq", "athlete_id", "year", "competition", "total")


@query("competition_results", f"""{WITH}
SELECT seq, athlete_name, competition, place, total FROM meet_results
WHERE division = 'Open' AND equipment = 'CLASSIC' AND year < 2000""")
def competition_results(spark, d):
    rows = S.competition_results(meet_results(spark, d), division="Open", equipment="classic", before_year=2000)
    return rows.select("seq", "athlete_name", "competition", "place", "total")


@query("result_list_top", f"""{WITH}
SELECT seq, year, competition, place, total FROM meet_results ORDER BY year DESC NULLS LAST,
  competition NULLS LAST, place NULLS LAST, total DESC NULLS LAST, athlete_name, seq LIMIT 50""")
def result_list_top(spark, d):
    return S.in_list_order(meet_results(spark, d), limit=50).select("seq", "year", "competition", "place", "total")


@query("latest_record", f"""{WITH}
SELECT seq, athlete_id, year, competition, total FROM meet_results
QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY year DESC, competition DESC, seq DESC) = 1""")
def latest_record(spark, d):
    return S.latest_record(meet_results(spark, d), "athlete_id").select(
        "seq", "athlete_id", "year", "competition", "total")


@query("snapshot", f"""{WITH}, latest AS (SELECT * FROM meet_results
QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY year DESC, competition DESC, seq DESC) = 1)
SELECT athlete_id, best_squat, total, array_to_string(list_filter([
    CASE WHEN bodyweight IS NULL THEN 'bodyweight' END, CASE WHEN best_squat IS NULL THEN 'best_squat' END,
    CASE WHEN best_bench IS NULL THEN 'best_bench' END, CASE WHEN best_deadlift IS NULL THEN 'best_deadlift' END,
    CASE WHEN total IS NULL THEN 'total' END], lambda x: x IS NOT NULL), ', ') AS missing_fields,
  (best_squat + best_bench + best_deadlift + total + bodyweight) IS NOT NULL AS complete FROM latest""")
def snapshot(spark, d):
    return S.performance_snapshot(S.latest_record(meet_results(spark, d), "athlete_id")).select(
        "athlete_id", "best_squat", "total", "missing_fields", "complete")


@query("find_athletes", f"""{WITH}, latest AS (SELECT * FROM meet_results
QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY year DESC, competition DESC, seq DESC) = 1)
SELECT l.athlete_id AS athlete, athlete_name, division, weight_class, date_of_birth, competition_count, first_year,
  latest_year FROM latest l JOIN (SELECT athlete_id, count(*) AS competition_count, min(year) AS first_year,
    max(year) AS latest_year FROM meet_results GROUP BY 1) USING (athlete_id)""")
def find_athletes(spark, d):
    return S.find_athletes(meet_results(spark, d), "athlete_id").select(
        "athlete", "athlete_name", "division", "weight_class", "date_of_birth", "competition_count", "first_year",
        "latest_year")


@query("athlete_options", f"""{WITH}, {_APPLIED_SQL}
SELECT resolved_athlete_id AS athlete, min(athlete_name) AS athlete_name FROM applied
WHERE resolved_athlete_id IS NOT NULL GROUP BY 1""")
def athlete_options(spark, d):
    return S.athlete_options(applied(spark, d))


@query("size_counts", f"{WITH} SELECT count(DISTINCT athlete_id) AS athletes, count(*) AS records FROM meet_results")
def size_counts(spark, d):
    return S.size_counts(meet_results(spark, d), "athlete_id")


@query("resolve_id", f"""{WITH}, {_APPLIED_SQL},
asked AS (SELECT DISTINCT 'ATH-' || substr(sha256(upper(trim(c_name))), 1, 16) AS requested_id FROM customer),
former AS (SELECT athlete_id, min(resolved_athlete_id) AS low, count(DISTINCT resolved_athlete_id) AS n
  FROM applied WHERE resolved_athlete_id IS NOT NULL GROUP BY 1),
judged AS (SELECT requested_id, low, CASE WHEN requested_id IN (SELECT resolved_athlete_id FROM applied
      WHERE resolved_athlete_id IS NOT NULL) THEN 'CURRENT' WHEN n IS NULL THEN 'UNKNOWN' WHEN n = 1 THEN 'ALIAS'
    ELSE 'AMBIGUOUS' END AS outcome FROM asked LEFT JOIN former ON requested_id = athlete_id)
SELECT requested_id, outcome, CASE outcome WHEN 'CURRENT' THEN requested_id WHEN 'ALIAS' THEN low END AS athlete
FROM judged""")
def resolve_id(spark, d):
    from meetlake.functions.text import athlete_id
    asked = table(spark, d, "customer").select(athlete_id(F.col("c_name")).alias("requested_id"))
    return S.resolve_ids(asked, applied(spark, d))


@query("coerced_events", """
SELECT event_id, TRY_CAST(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS INTEGER) AS place,
  trim(event_type) AS team FROM events""")
def coerced_events(spark, d):
    raw = table(spark, d, "events").select(
        "event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("place"),
        F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("team"))
    return S.coerce_numbers(S.trim_texts(raw))
