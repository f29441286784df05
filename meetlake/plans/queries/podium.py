"""Queries over podiums, fields, rankings and meet-day plans."""

from pyspark.sql import functions as F

from meetlake.functions.text import CLASS_LIMITS, OPEN_CLASS
from meetlake.operators import planning as P
from meetlake.operators import podium as PO
from meetlake.plans.queries.quality import WITH
from meetlake.plans.registry import query
from meetlake.plans.tables import meet_results
from meetlake.schema import BESTS, LIFTS
from meetlake.session import pinned

DIVISIONS = ("Open", "Junior", "Sub Junior", "Master 1", "Master 2")


def questions(field):
    """One question per class and target year 1996..2003, cycling through divisions, labels and tiers."""
    y = F.col("target_year")
    return (field.select("weight_class").distinct()
            .select("weight_class", F.explode(F.sequence(F.lit(1996), F.lit(2003))).alias("target_year"))
            .select(F.concat_ws("/", "weight_class", "target_year").alias("question_id"), "weight_class", "target_year",
                    F.element_at(F.array(*[F.lit(v) for v in DIVISIONS]), y % 5 + 1).alias("division"),
                    F.when(y % 2 == 0, "raw").otherwise("Equipped").alias("equipment"),
                    F.element_at(F.array(F.lit("State"), F.lit("National"), F.lit("International")), y % 3 + 1).alias("meet_tier"),
                    F.when(y % 4 == 0, F.concat(F.lit("National Classic Meet "), y, F.lit(" Q2"))).alias("competition")))


QUESTIONS_SQL = """
questions AS (
  SELECT weight_class || '/' || target_year AS question_id, weight_class AS q_class, target_year,
    ['Open', 'Junior', 'Sub Junior', 'Master 1', 'Master 2'][target_year % 5 + 1] AS q_division,
    CASE target_year % 2 WHEN 0 THEN 'CLASSIC' ELSE 'EQUIPPED' END AS q_equipment,
    ['state', 'national', 'international'][target_year % 3 + 1] AS q_tier,
    CASE WHEN target_year % 4 = 0 THEN 'National Classic Meet ' || target_year || ' Q2' END AS q_meet
  FROM (SELECT DISTINCT weight_class FROM meet_results), (SELECT CAST(unnest(range(1996, 2004)) AS INTEGER) AS target_year))"""

_LEVEL = """CASE WHEN division = q_division AND equipment = q_equipment THEN 0 WHEN division = q_division THEN 1
      WHEN equipment = q_equipment THEN 2 ELSE 3 END"""

PODIUM_SQL = f"""{QUESTIONS_SQL},
past AS (
  SELECT q.question_id, year, {_LEVEL} AS scope FROM questions q JOIN meet_results
    ON weight_class = q_class AND year < target_year QUALIFY scope = min(scope) OVER (PARTITION BY question_id)),
past_years AS (
  SELECT DISTINCT question_id, year FROM past
  QUALIFY dense_rank() OVER (PARTITION BY question_id ORDER BY year DESC) <= 3),
asked AS (
  SELECT q.*, target_year AS asked_year FROM questions q
  UNION ALL SELECT q.*, p.year FROM questions q JOIN past_years p USING (question_id)),
near AS (
  SELECT a.*, m.place, m.total,
    2 * ({_LEVEL}) + CASE WHEN competition = q_meet THEN 0 ELSE 1 END AS scope,
    CASE WHEN competition = q_meet THEN 0 WHEN q_tier = 'national' AND lower(competition) LIKE '%national%' THEN 1
      WHEN q_tier = 'international' AND regexp_matches(lower(competition), 'international|world|asia|asian') THEN 1
      ELSE 2 END AS hint
  FROM asked a JOIN meet_results m ON m.weight_class = q_class AND m.year = asked_year),
in_scope AS (SELECT * FROM near QUALIFY scope = min(scope) OVER (PARTITION BY question_id, asked_year)),
hinted AS (SELECT * FROM in_scope QUALIFY hint = min(hint) OVER (PARTITION BY question_id, asked_year)),
placed AS (
  SELECT question_id, target_year, asked_year, max(CASE WHEN place = 1 THEN total END) AS p1,
    max(CASE WHEN place = 2 THEN total END) AS p2, max(CASE WHEN place = 3 THEN total END) AS p3,
    list_reverse_sort(list_distinct(list(total))) AS totals
  FROM hinted WHERE total IS NOT NULL GROUP BY ALL),
spare AS (
  SELECT *, list_filter(totals, lambda x: NOT list_contains(list_filter([p1, p2, p3], lambda y: y IS NOT NULL), x)) AS extra
  FROM placed),
podiums AS (
  SELECT question_id, target_year, asked_year AS year, coalesce(p1, extra[1]) AS gold,
    coalesce(p2, extra[1 + (p1 IS NULL)::INT]) AS silver,
    coalesce(p3, extra[1 + (p1 IS NULL)::INT + (p2 IS NULL)::INT]) AS bronze
  FROM spare),
complete AS (SELECT * FROM podiums WHERE gold IS NOT NULL AND silver IS NOT NULL AND bronze IS NOT NULL)"""

_METALS = ("gold", "silver", "bronze")
_FACTS = ", ".join(
    f"max(CASE WHEN year = target_year THEN {m} END) AS real_{m}, "
    f"arg_max({m}, year) FILTER (WHERE year < target_year) AS last_{m}, "
    f"greatest(0.0, regr_intercept({m}, year) FILTER (WHERE year < target_year) "
    f"+ regr_slope({m}, year) FILTER (WHERE year < target_year) * target_year) AS t_{m}" for m in _METALS)
THRESHOLD_SQL = f"""{PODIUM_SQL},
facts AS (
  SELECT question_id, target_year, count(*) FILTER (WHERE year < target_year) AS n,
    max(year) FILTER (WHERE year < target_year) AS last_year,
    arg_max(bronze, year) FILTER (WHERE year < target_year) AS newest,
    arg_min(bronze, year) FILTER (WHERE year < target_year) AS oldest, {_FACTS}
  FROM complete GROUP BY question_id, target_year),
thresholds AS (
  SELECT question_id, target_year,
    round_even(CASE WHEN real_gold IS NOT NULL THEN real_gold WHEN n = 1 THEN last_gold
      ELSE greatest(t_gold, t_silver, t_bronze) END, 2) AS gold,
    round_even(CASE WHEN real_gold IS NOT NULL THEN real_silver WHEN n = 1 THEN last_silver
      ELSE least(greatest(t_gold, t_silver, t_bronze), greatest(t_silver, t_bronze)) END, 2) AS silver,
    round_even(CASE WHEN real_gold IS NOT NULL THEN real_bronze WHEN n = 1 THEN last_bronze
      ELSE least(greatest(t_gold, t_silver, t_bronze), greatest(t_silver, t_bronze), t_bronze) END, 2) AS bronze,
    CASE WHEN real_gold IS NOT NULL OR n = 1 OR newest = oldest THEN 'flat' WHEN newest > oldest THEN 'rising'
      ELSE 'falling' END AS trend,
    CASE WHEN real_gold IS NOT NULL THEN 'historical_real' WHEN n = 1 THEN 'historical_real_benchmark'
      ELSE 'future_real_data_projection' END AS data_status,
    CASE WHEN real_gold IS NOT NULL THEN target_year ELSE last_year END AS benchmark_year
  FROM facts)"""


def filed(spark, d):
    """The result columns the podium queries read, computed once for the field table and the rows."""
    return pinned(meet_results(spark, d).select(
        "seq", "athlete_id", "athlete_name", *PO.FIELD, "bodyweight", *BESTS, "total", "place"))


def fields(results):
    return pinned(PO.field_table(results))


def asked(results):
    """Questions and the field table they are answered from."""
    field = fields(results)
    return questions(field), field


def thresholds(results):
    return PO.podium_threshold(*asked(results))


@query("podium", f"{WITH}, {PODIUM_SQL} SELECT question_id, target_year, year, gold, silver, bronze FROM complete")
def podium(spark, d):
    return PO.podium_history(*asked(meet_results(spark, d)))


@query("podium_threshold", f"{WITH}, {THRESHOLD_SQL} SELECT * FROM thresholds")
def podium_threshold(spark, d):
    return thresholds(meet_results(spark, d))


@query("podium_trend", f"""{WITH}, {PODIUM_SQL}
SELECT question_id, year, gold, silver, bronze, gold - lag(gold) OVER w AS gold_delta,
  silver - lag(silver) OVER w AS silver_delta, bronze - lag(bronze) OVER w AS bronze_delta
FROM complete WINDOW w AS (PARTITION BY question_id ORDER BY year)""")
def podium_trend(spark, d):
    return PO.podium_trend(PO.podium_history(*asked(meet_results(spark, d))))


_FIELD_SQL = f"""{QUESTIONS_SQL},
now AS (
  SELECT q.question_id, m.*, 2 * ({_LEVEL}) + CASE WHEN competition = q_meet THEN 0 ELSE 1 END AS step
  FROM questions q JOIN meet_results m ON weight_class = q_class AND year = target_year
  QUALIFY step = min(step) OVER (PARTITION BY question_id)),
before AS (
  SELECT q.question_id, m.*, {_LEVEL} AS scope FROM questions q JOIN meet_results m
    ON weight_class = q_class AND year < target_year WHERE question_id NOT IN (SELECT question_id FROM now)
  QUALIFY scope = min(scope) OVER (PARTITION BY question_id)),
latest AS (SELECT * FROM before QUALIFY year = max(year) OVER (PARTITION BY question_id)),
field AS (
  SELECT question_id, seq, year, total, step // 2 AS scope, TRUE AS current FROM now
  UNION ALL SELECT question_id, seq, year, total, scope, FALSE FROM latest)"""


@query("competitors", f"""{WITH}, {_FIELD_SQL}
SELECT question_id, seq, year AS benchmark_year, total AS total_kg,
  CASE WHEN scope = 0 AND current THEN 'historical_real' WHEN scope = 0 THEN 'historical_real_benchmark'
    ELSE 'historical_real_broader_benchmark' END AS data_status,
  ['exact division + equipment', 'same division, any equipment', 'same equipment, any division',
    'same weight class, any division/equipment'][scope + 1] AS scope_status FROM field""")
def competitors(spark, d):
    results = filed(spark, d)
    about, field = asked(results)
    return PO.engine_columns(PO.competitors(about, results, field)).select("question_id", "seq", "benchmark_year", "total_kg", "data_status", "scope_status")


@query("best_scope", f"{WITH}, {_FIELD_SQL} SELECT question_id, min(scope) AS scope, count(*) AS records FROM field GROUP BY 1")
def best_scope(spark, d):
    results = filed(spark, d)
    label = F.array_position(F.array(*[F.lit(s) for s in PO.SCOPES]), F.col("scope_status")) - 1
    about, field = asked(results)
    return PO.competitors(about, results, field).groupBy("question_id").agg(
        F.min(label).alias("scope"), F.count(F.lit(1)).alias("records"))


@query("top5_benchmark", f"""{WITH}, {_FIELD_SQL}
SELECT question_id, total AS benchmark FROM field WHERE total IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY total DESC) = 5""")
def top5_benchmark(spark, d):
    results = filed(spark, d)
    about, field = asked(results)
    return PO.kth_total(about, results, field)


@query("leaderboard", f"""{WITH}
SELECT weight_class, year, seq, total, row_number() OVER w AS projected_rank FROM meet_results
WINDOW w AS (PARTITION BY weight_class, year ORDER BY total DESC NULLS LAST, seq)
QUALIFY row_number() OVER w <= 12""")
def leaderboard(spark, d):
    return PO.leaderboard(meet_results(spark, d), ("weight_class", "year"), "total").select(
        "weight_class", "year", "seq", "total", "projected_rank")


@query("user_rank", f"""{WITH}
SELECT seq, total, rank() OVER (PARTITION BY weight_class, year ORDER BY total DESC) AS projected_rank
FROM meet_results WHERE total IS NOT NULL""")
def user_rank(spark, d):
    results = meet_results(spark, d)
    users = results.select("seq", "weight_class", "year", "total").where("total IS NOT NULL")
    return PO.user_ranks(users, results, ("weight_class", "year")).select("seq", "total", "projected_rank")


# every complete result of 2001 asks about its class in 2003
_USERS_SQL = f"""{THRESHOLD_SQL},
users AS (
  SELECT m.seq, m.athlete_id, m.bodyweight, m.best_squat, m.best_bench, m.best_deadlift, m.total, t.gold, t.silver,
    t.bronze, m.best_squat + m.best_bench + m.best_deadlift AS lifted
  FROM meet_results m JOIN thresholds t ON t.question_id = m.weight_class || '/2003'
  WHERE m.best_squat IS NOT NULL AND m.best_bench IS NOT NULL AND m.best_deadlift IS NOT NULL)"""


def user_thresholds(spark, d):
    """Complete results that ask about their class in 2003, and all thresholds."""
    results = filed(spark, d)
    have = results.where("best_squat IS NOT NULL AND best_bench IS NOT NULL AND best_deadlift IS NOT NULL")
    have = have.withColumn("question_id", F.concat(F.col("weight_class"), F.lit("/2003")))
    return have, thresholds(results)


def users(spark, d):
    have, bars = user_thresholds(spark, d)
    # one row per weight class and target year: its bound
    return have.join(F.broadcast(bars.select("question_id", "gold", "silver", "bronze")), "question_id")


@query("podium_gaps", f"""{WITH}, {_USERS_SQL}
SELECT seq, greatest(0.0, gold - total) AS gold_gap, greatest(0.0, silver - total) AS silver_gap,
  greatest(0.0, bronze - total) AS bronze_gap,
  CASE WHEN total <= 0 THEN 'no baseline' WHEN greatest(0.0, bronze - total) <= 0 THEN 'reached' WHEN greatest(0.0, bronze - total) <= 25 THEN 'close'
    WHEN greatest(0.0, bronze - total) <= 60 THEN 'meaningful' ELSE 'substantial' END AS band FROM users""")
def podium_gaps(spark, d):
    gaps = PO.podium_gaps(*user_thresholds(spark, d))
    return gaps.select("seq", "gold_gap", "silver_gap", "bronze_gap",
                       P.gap_band(F.col("total"), F.col("bronze_gap")).alias("band"))


_SHARES = ", ".join(f"best_{k} / lifted AS share_{k}" for k in LIFTS)
_GAPS = ", ".join(f"greatest(0.0, (best_{k} + gap * share_{k}) - best_{k}) AS g_{k}" for k in LIFTS)


@query("gap_analysis", f"""{WITH}, {_USERS_SQL},
shared AS (SELECT *, greatest(0.0, bronze - lifted) AS gap, {_SHARES} FROM users WHERE lifted > 0),
parts AS (SELECT *, {_GAPS} FROM shared)
SELECT seq, round_even(lifted, 2) AS current_total, round_even(greatest(bronze, lifted), 2) AS target_total,
  round_even(gap, 2) AS total_gap, {", ".join(f"round_even(best_{k} + gap * share_{k}, 2) AS target_{k}" for k in LIFTS)},
  CASE WHEN gap <= 0 THEN 'none' WHEN g_squat >= g_bench AND g_squat >= g_deadlift THEN 'squat'
    WHEN g_bench >= g_deadlift THEN 'bench' ELSE 'deadlift' END AS priority_lift FROM parts""")
def gap_analysis(spark, d):
    own = users(spark, d).where("best_squat + best_bench + best_deadlift > 0")
    return P.gap_analysis(own).select("seq", "current_total", "target_total", "total_gap",
                                      *[f"target_{k}" for k in LIFTS], "priority_lift")


_INDEX_SQL = " + ".join(f"(bodyweight > {k})::INT" for k in (53, 59, 66, 74, 83, 93, 105, 120))


@query("class_comparison", f"""{WITH}, {THRESHOLD_SQL},
bars AS (SELECT list_position(['53', '59', '66', '74', '83', '93', '105', '120', '120+'], split_part(question_id, '/', 1)) - 1
  AS idx, bronze FROM thresholds WHERE target_year = 2003),
own AS (SELECT seq, {_INDEX_SQL} AS idx FROM meet_results),
around AS (SELECT o.seq, o.idx AS own_idx, b.idx, b.bronze FROM own o JOIN bars b ON b.idx BETWEEN o.idx - 1 AND o.idx + 1),
picked AS (SELECT seq, own_idx AS class_index, count(*) AS compared, max(CASE WHEN idx = own_idx THEN bronze END) AS cur,
  min(bronze) AS low FROM around GROUP BY seq, own_idx)
SELECT p.seq, class_index, compared, min(a.idx) AS recommended_index, cur AS current_bronze, low AS recommended_bronze,
  round_even(low - cur, 2) AS difference FROM picked p JOIN around a ON a.seq = p.seq AND a.bronze = p.low
WHERE cur IS NOT NULL GROUP BY ALL""")
def class_comparison(spark, d):
    results = filed(spark, d)
    bars = thresholds(results).where("target_year = 2003").withColumn("weight_class", F.split("question_id", "/")[0])
    labels = F.array(*[F.lit(str(k)) for k in CLASS_LIMITS], F.lit(OPEN_CLASS))
    bars = bars.withColumn("class_index", (F.array_position(labels, F.col("weight_class")) - 1).cast("int"))
    athletes = results.select("seq", "bodyweight", F.lit(2003).alias("target_year"))
    return PO.class_comparison(athletes, bars).drop("bodyweight", "target_year")


@query("objective_target", f"""{WITH}, {_USERS_SQL}
SELECT seq, ceil((greatest(lifted + 2.5, bronze) - 1e-9) / 2.5) * 2.5 AS podium_target,
  ceil((lifted + 2.5 - 1e-9) / 2.5) * 2.5 AS record_target FROM users""")
def objective_target(spark, d):
    total = F.col("best_squat") + F.col("best_bench") + F.col("best_deadlift")
    none = F.lit(None).cast("double")
    return users(spark, d).select(
        "seq", P.objective_target(F.lit("Podium"), total, F.col("bronze"), none).alias("podium_target"),
        P.objective_target(F.lit("Beat my PR"), total, none, none).alias("record_target"))


def plans(spark, d):
    total = F.col("best_squat") + F.col("best_bench") + F.col("best_deadlift")
    strategy = F.element_at(F.array(F.lit("Conservative"), F.lit("Balanced"), F.lit("Aggressive")),
                            (F.col("seq") % 3 + 1).cast("int"))
    own = users(spark, d).where(total > 0).select("seq", *[f"best_{k}" for k in LIFTS], strategy.alias("strategy"), P.objective_target(
        F.lit("Podium"), total, F.col("bronze"), F.lit(None).cast("double")).alias("target_total"))
    return P.attempt_plan(own)


def _lift_sql(k):
    return (f"least(floor(best_{k} * o / 2.5 + 0.5) * 2.5, floor(best_{k} / 2.5 + 0.5) * 2.5) AS {k}_open, "
            f"greatest({k}_open, floor(best_{k} * s / 2.5 + 0.5) * 2.5) AS {k}_second, "
            f"greatest({k}_second, floor((best_{k} * c + 1e-9) / 2.5) * 2.5) AS {k}_cap, "
            f"best_{k} + rise * (best_{k} / lifted) AS {k}_wish, "
            f"least({k}_cap, greatest({k}_second, floor({k}_wish / 2.5 + 0.5) * 2.5)) AS {k}_start")


PLAN_SQL = f"""{_USERS_SQL},
aims AS (
  SELECT *, ceil((greatest(lifted + 2.5, bronze) - 1e-9) / 2.5) * 2.5 AS target_total,
    ceil((greatest(target_total, lifted) - 1e-9) / 2.5) * 2.5 AS aim, greatest(0.0, aim - lifted) AS rise,
    [0.93, 0.95, 0.97][seq % 3 + 1] AS o, [1.00, 1.02, 1.04][seq % 3 + 1] AS s, [1.04, 1.07, 1.10][seq % 3 + 1] AS c
  FROM users WHERE lifted > 0),
bounds AS (SELECT *, {", ".join(_lift_sql(k) for k in LIFTS)} FROM aims),
walk AS (
  WITH RECURSIVE steps AS (
    SELECT b.*, squat_start AS squat, bench_start AS bench, deadlift_start AS deadlift, 0 AS n FROM bounds b
    UNION ALL
    SELECT * EXCLUDE (squat, bench, deadlift, n, pick, os, ob, od),
      squat + CASE pick WHEN 1 THEN 2.5 ELSE 0 END, bench + CASE pick WHEN 2 THEN 2.5 ELSE 0 END,
      deadlift + CASE pick WHEN 3 THEN 2.5 ELSE 0 END, n + 1
    FROM (SELECT *, list_position([os, ob, od], list_max([os, ob, od])) AS pick FROM (
      SELECT *, CASE WHEN squat + 2.5 <= squat_cap + 1e-9 THEN (squat_wish - squat, best_squat) END AS os,
        CASE WHEN bench + 2.5 <= bench_cap + 1e-9 THEN (bench_wish - bench, best_bench) END AS ob,
        CASE WHEN deadlift + 2.5 <= deadlift_cap + 1e-9 THEN (deadlift_wish - deadlift, best_deadlift) END AS od
      FROM steps WHERE aim - (squat + bench + deadlift) >= 2.5)
      WHERE os IS NOT NULL OR ob IS NOT NULL OR od IS NOT NULL))
  SELECT * FROM steps),
plans AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY seq ORDER BY n DESC) = 1)"""


@query("attempt_plan", f"""{WITH}, {PLAN_SQL}
SELECT seq, target_total, aim AS target_rounded, {", ".join(
    f"{k}_open AS {k}_attempt_1, {k}_second AS {k}_attempt_2, {k} AS {k}_attempt_3, {k}_cap" for k in LIFTS)} FROM plans""")
def attempt_plan(spark, d):
    return plans(spark, d).select("seq", "target_total", "target_rounded", *[
        c for k in LIFTS for c in (f"{k}_attempt_1", f"{k}_attempt_2", f"{k}_attempt_3", f"{k}_cap")])


@query("plan_status", f"""{WITH}, {PLAN_SQL}
SELECT seq, squat + bench + deadlift AS planned_total, squat + bench + deadlift - target_total AS difference,
  CASE WHEN abs(squat + bench + deadlift - target_total) < 0.01 THEN 'Target aligned'
    WHEN squat + bench + deadlift > target_total THEN 'Above target' ELSE 'Realistic plan below target' END AS plan_status
FROM plans""")
def plan_status(spark, d):
    return P.plan_status(plans(spark, d)).select("seq", "planned_total", "difference", "plan_status")


@query("focus_lift", f"""{WITH}, {PLAN_SQL},
gains AS (SELECT seq, squat - best_squat AS a, bench - best_bench AS b, deadlift - best_deadlift AS c FROM plans)
SELECT seq, CASE WHEN a >= b AND a >= c THEN 'squat' WHEN b >= c THEN 'bench' ELSE 'deadlift' END AS focus_lift,
  CASE WHEN a <= b AND a <= c THEN 'squat' WHEN b <= c THEN 'bench' ELSE 'deadlift' END AS stable_lift FROM gains""")
def focus_lift(spark, d):
    return P.focus_lift(plans(spark, d)).select("seq", "focus_lift", "stable_lift")
