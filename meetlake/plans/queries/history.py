"""Queries over yearly features, history examples and their audits."""

from pyspark.sql import functions as F

from meetlake.functions.numbers import steady
from meetlake.operators import history as H
from meetlake.operators import temporal as TF
from meetlake.plans.registry import query
from meetlake.plans.tables import MEET_RESULTS_SQL, meet_results, table
from meetlake.schema import LIFTS, PRODUCTION_FEATURES, TARGETS
from meetlake.session import pinned

AVERAGED = ("year_total_mean", "year_bodyweight_mean", "previous_total", "previous_bodyweight",
            "historical_mean_total", "historical_std_total", "historical_mean_bodyweight",
            "previous_total_change", "previous_total_change_pct")


def _steady(df):
    return df.select(*[steady(F.col(c)).alias(c) if c in AVERAGED else c for c in df.columns])


def _r(c: str) -> str:
    return f"floor({c} * 1e4 + 0.5001) / 1e4 AS {c}"


YEARS_SQL = """
athlete_years AS (
  SELECT athlete_id, year, avg(total) AS year_total_mean, max(total) AS year_total_max,
    min(total) AS year_total_min, max(best_squat) AS year_best_squat, max(best_bench) AS year_best_bench,
    max(best_deadlift) AS year_best_deadlift, avg(bodyweight) AS year_bodyweight_mean
  FROM meet_results GROUP BY athlete_id, year)"""

FEATURES_SQL = YEARS_SQL + """,
seen AS (
  SELECT *, lag(year) OVER w AS previous_year, lag(year_total_mean) OVER w AS previous_total,
    lag(year_best_squat) OVER w AS previous_squat, lag(year_best_bench) OVER w AS previous_bench,
    lag(year_best_deadlift) OVER w AS previous_deadlift, lag(year_bodyweight_mean) OVER w AS previous_bodyweight,
    lag(year_total_mean, 2) OVER w AS two_back, row_number() OVER w - 1 AS previous_year_count,
    avg(year_total_mean) OVER b AS historical_mean_total, max(year_total_max) OVER b AS historical_max_total,
    min(year_total_min) OVER b AS historical_min_total, stddev_samp(year_total_mean) OVER b AS historical_std_total,
    max(year_best_squat) OVER b AS historical_max_squat, max(year_best_bench) OVER b AS historical_max_bench,
    max(year_best_deadlift) OVER b AS historical_max_deadlift,
    avg(year_bodyweight_mean) OVER b AS historical_mean_bodyweight
  FROM athlete_years
  WINDOW w AS (PARTITION BY athlete_id ORDER BY year),
    b AS (PARTITION BY athlete_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
features AS (
  SELECT *, year - previous_year AS years_since_previous, previous_total - two_back AS previous_total_change,
    (previous_total - two_back) / nullif(two_back, 0) * 100 AS previous_total_change_pct
  FROM seen)"""

YEAR_COLUMNS = ("year_total_mean", "year_total_max", "year_total_min", "year_best_squat", "year_best_bench",
                "year_best_deadlift", "year_bodyweight_mean")
HISTORY = PRODUCTION_FEATURES[4:]


def _cols(names):
    return ", ".join(_r(c) if c in AVERAGED else c for c in names)


@query("athlete_year", f"WITH {MEET_RESULTS_SQL}, {YEARS_SQL} "
       f"SELECT athlete_id, year, {_cols(YEAR_COLUMNS)} FROM athlete_years")
def _(spark, d):
    return _steady(TF.athlete_year(meet_results(spark, d), "athlete_id"))


@query("temporal_features", f"WITH {MEET_RESULTS_SQL}, {FEATURES_SQL} "
       f"SELECT athlete_id, year, {_cols(HISTORY)} FROM features")
def _(spark, d):
    years = TF.athlete_year(meet_results(spark, d), "athlete_id")
    return _steady(TF.temporal_features(years, "athlete_id").select("athlete_id", "year", *HISTORY))


@query("supervised_temporal", f"WITH {MEET_RESULTS_SQL}, {FEATURES_SQL} "
       f"SELECT m.seq, athlete_id, year, m.total, m.best_squat, {_cols(HISTORY)} "
       "FROM meet_results m JOIN features USING (athlete_id, year) WHERE previous_year_count >= 1")
def supervised_temporal(spark, d):
    rows = TF.supervised_dataset(meet_results(spark, d), "athlete_id")
    return _steady(rows.select("seq", "athlete_id", "year", "total", "best_squat", *HISTORY))


@query("production_features", f"WITH {MEET_RESULTS_SQL}, {FEATURES_SQL} "
       f"SELECT year, division, weight_class, equipment, {_cols(HISTORY)} "
       "FROM meet_results m JOIN features USING (athlete_id, year) WHERE previous_year_count >= 1")
def _(spark, d):
    return _steady(TF.production_features(TF.supervised_dataset(meet_results(spark, d), "athlete_id")))


@query("chronology_check", f"""WITH {MEET_RESULTS_SQL}, {FEATURES_SQL}
SELECT count(*) AS rows, count_if(previous_year >= year) AS previous_not_before,
  count_if(years_since_previous <= 0) AS gap_not_positive,
  count_if(historical_max_squat < previous_squat) AS squat_max_below_previous,
  count_if(historical_max_bench < previous_bench) AS bench_max_below_previous,
  count_if(historical_max_deadlift < previous_deadlift) AS deadlift_max_below_previous,
  count_if(historical_max_total < historical_min_total) AS max_below_min,
  count_if(previous_year_count = 0 AND previous_total IS NOT NULL) AS history_without_years
FROM meet_results JOIN features USING (athlete_id, year)""")
def _(spark, d):
    return TF.chronology_check(TF.temporal_dataset(meet_results(spark, d), "athlete_id"))


EVENT_DAYS_SQL = """
days AS (
  SELECT user_id, CAST(dayofyear(ts) AS INTEGER) AS year, avg(value) AS year_total_mean,
    max(value) AS year_total_max FROM events GROUP BY 1, 2)"""


@query("event_day_features", f"""WITH {EVENT_DAYS_SQL}
SELECT user_id, year, lag(year) OVER w AS previous_year, row_number() OVER w - 1 AS previous_year_count,
  max(year_total_max) OVER (PARTITION BY user_id ORDER BY year
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS historical_max_total
FROM days WINDOW w AS (PARTITION BY user_id ORDER BY year)""")
def _(spark, d):
    results = table(spark, d, "events").select(
        "user_id", F.dayofyear("ts").alias("year"), F.col("value").alias("total"),
        *[F.lit(None).cast("double").alias(c) for c in ("best_squat", "best_bench", "best_deadlift", "bodyweight")])
    return TF.temporal_features(TF.athlete_year(results, "user_id"), "user_id").select(
        "user_id", "year", "previous_year", "previous_year_count", "historical_max_total")


_BEST_SQL = ", ".join(f"max(best_{x}) OVER b AS historical_best_{x}" for x in LIFTS)
_TRY_SQL = ", ".join(f"max(greatest({x}_1, {x}_2, {x}_3)) OVER b AS historical_best_{x}_attempt" for x in LIFTS)
_PREV_SQL = ", ".join(f"lag({c}) OVER w AS previous_{c}" for c in H.PREVIOUS)


@query("history_examples", f"""WITH {MEET_RESULTS_SQL}, seen AS (
SELECT athlete_id, seq, year AS target_year, competition AS target_competition,
  row_number() OVER w - 1 AS previous_competition_count, {_BEST_SQL}, max(total) OVER b AS historical_best_total,
  {_TRY_SQL}, {_PREV_SQL}, {", ".join(f"{t} AS target_{t}" for t in TARGETS)}
FROM meet_results
WINDOW w AS (PARTITION BY athlete_id ORDER BY year, competition, seq),
  b AS (PARTITION BY athlete_id ORDER BY year, competition, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT * FROM seen WHERE previous_competition_count > 0""")
def history_examples(spark, d):
    return H.flat_examples(H.history_examples(meet_results(spark, d)))


@query("complete_targets", f"""WITH {MEET_RESULTS_SQL}, seen AS (
SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY year, competition, seq) AS n FROM meet_results)
SELECT seq, best_squat, best_bench, best_deadlift, total FROM seen
WHERE n > 1 AND best_squat IS NOT NULL AND best_bench IS NOT NULL AND best_deadlift IS NOT NULL AND total IS NOT NULL""")
def _(spark, d):
    examples = H.history_examples(meet_results(spark, d))
    return examples.where(H.target_complete()).select("seq", "target.*")


@query("leakage_audit", f"""WITH {MEET_RESULTS_SQL}, seen AS (
SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY year, competition, seq) AS n,
  count(*) OVER (PARTITION BY athlete_id, year, competition) AS same_meet FROM meet_results),
judged AS (
SELECT same_meet, EXISTS (SELECT 1 FROM seen h WHERE h.athlete_id = t.athlete_id AND h.n < t.n
    AND h.best_squat IS NOT DISTINCT FROM t.best_squat AND h.best_bench IS NOT DISTINCT FROM t.best_bench
    AND h.best_deadlift IS NOT DISTINCT FROM t.best_deadlift AND h.total IS NOT DISTINCT FROM t.total) AS repeated
FROM seen t WHERE n > 1)
SELECT count(*) AS total_examples, count_if(same_meet <> 1) AS examples_with_target_in_history,
  CAST(0 AS BIGINT) AS examples_with_future_year_in_history,
  count_if(same_meet = 1 AND repeated) AS examples_with_target_values_in_history,
  CAST(0 AS BIGINT) AS athlete_ordering_violations,
  count_if(same_meet <> 1 OR repeated) = 0 AS passed FROM judged""")
def _(spark, d):
    # the audit reads its input along two ways, so the few columns it needs are computed once
    return H.leakage_audit(pinned(meet_results(spark, d).select("seq", "athlete_id", "year", "competition", *TARGETS)))


@query("order_audit", f"""WITH {MEET_RESULTS_SQL}, seen AS (
SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY athlete_id, year, competition) AS at_meet,
  max({{'y': year, 'c': competition}}) OVER (PARTITION BY athlete_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest,
  lag({{'y': year, 'c': competition}}) OVER w AS last, {{'y': year, 'c': competition}} AS here,
  min(seq) OVER (PARTITION BY athlete_id, best_squat, best_bench, best_deadlift, total) AS first
FROM meet_results WINDOW w AS (PARTITION BY athlete_id ORDER BY seq)),
counted AS (
SELECT count(*) AS total_examples, count_if(at_meet <> 1) AS examples_with_target_in_history,
  count_if(at_meet = 1 AND latest > here) AS examples_with_future_year_in_history,
  count_if(at_meet = 1 AND first < seq) AS examples_with_target_values_in_history,
  count_if(here < last) AS athlete_ordering_violations FROM seen WHERE n > 1)
SELECT *, examples_with_target_in_history + examples_with_future_year_in_history + examples_with_target_values_in_history
  + athlete_ordering_violations = 0 AS passed FROM counted""")
def order_audit(spark, d):
    """The tables' filing order is no order of time, so the counters are above zero."""
    return H.order_audit(meet_results(spark, d).select("seq", "athlete_id", "year", "competition", *TARGETS), "seq")
