"""Queries over splits, baselines, error reports and models. The tables cover 1995 to 2001."""

from pyspark.sql import functions as F

from meetlake.functions.numbers import steady
from meetlake.operators import metrics as M
from meetlake.operators import podium as PO
from meetlake.operators import temporal as TF
from meetlake.plans import models as ML
from meetlake.plans.queries.history import FEATURES_SQL
from meetlake.plans.queries.quality import R4, WITH
from meetlake.plans.registry import query
from meetlake.plans.tables import meet_results, table
from meetlake.schema import PRODUCTION_FEATURES, TARGETS
from meetlake.session import file_stamp, fresh_folder, pinned

TRAIN_END, VALIDATION_END = 1998, 2000

SPLIT_SQL = f"""{FEATURES_SQL},
supervised AS (
  SELECT m.*, f.* EXCLUDE (athlete_id, year), CASE WHEN year <= 1998 THEN 'train' WHEN year <= 2000 THEN 'validation'
    ELSE 'test' END AS split FROM meet_results m JOIN features f USING (athlete_id, year) WHERE previous_year_count >= 1)"""


def supervised(spark, d):
    rows = TF.supervised_dataset(meet_results(spark, d), "athlete_id")
    return M.with_split(rows, TRAIN_END, VALIDATION_END)


@query("split_summary", f"""{WITH}, {SPLIT_SQL}
SELECT split, count(*) AS records, count(DISTINCT athlete_id) AS athletes, min(year) AS first_year, max(year) AS last_year,
  round_even(count(*) / (SELECT count(*) FROM supervised) * 100, 2) AS percent FROM supervised GROUP BY split""")
def split_summary(spark, d):
    return M.split_summary(supervised(spark, d), "athlete_id")


@query("shared_years", f"""{WITH}, {SPLIT_SQL}
SELECT year, count(DISTINCT split) AS splits FROM supervised GROUP BY year HAVING count(DISTINCT split) > 1""")
def shared_years(spark, d):
    return M.shared_years(supervised(spark, d))


@query("target_stats", f"{WITH}, {SPLIT_SQL} " + " UNION ALL ".join(
    f"SELECT split, '{t}' AS target, count({t}) AS count, {R4.format(f'avg({t})')} AS mean, "
    f"{R4.format(f'stddev_samp({t})')} AS std, min({t}) AS min, max({t}) AS max FROM supervised GROUP BY split"
    for t in TARGETS))
def target_stats(spark, d):
    return M.target_stats(supervised(spark, d)).withColumns({c: steady(F.col(c)) for c in ("mean", "std")})


_LAST = {"best_squat": "previous_squat", "best_bench": "previous_bench", "best_deadlift": "previous_deadlift",
         "total": "previous_total"}
BASELINE_SQL = f"""{SPLIT_SQL},
judged AS (SELECT * FROM supervised WHERE split <> 'train'),
baseline AS (""" + " UNION ALL ".join(
    f"SELECT split, 'Train Mean' AS model, '{t}' AS target, {t} AS actual, "
    f"(SELECT avg({t}) FROM supervised WHERE split = 'train') AS predicted FROM judged UNION ALL "
    f"SELECT split, 'Previous Performance', '{t}', {t}, {_LAST[t]} FROM judged" for t in TARGETS) + """),
errors AS (SELECT *, predicted - actual AS error FROM baseline WHERE actual IS NOT NULL AND predicted IS NOT NULL)"""
_METRICS = f"""{R4.format('avg(abs(error))')} AS mae, {R4.format('sqrt(avg(error * error))')} AS rmse,
  {R4.format('(1 - avg(error * error) / var_pop(actual))')} AS r2, {R4.format('avg(error)')} AS mean_error,
  {R4.format('median(abs(error))')} AS median_absolute_error"""


def baseline(spark, d):
    """Baselines of the supervised table, which is computed once: training mean and judged rows both read it."""
    return M.baseline_predictions(pinned(supervised(spark, d).select("split", *TARGETS, *_LAST.values())))


def baseline_metrics(spark, d):
    """Eight rows of metrics, pinned because rankings and comparisons read them more than once."""
    return pinned(M.error_metrics(baseline(spark, d)))


@query("baseline_metrics", f"{WITH}, {BASELINE_SQL} SELECT model, target, count(*) AS n, {_METRICS} FROM errors GROUP BY 1, 2")
def baseline_table(spark, d):
    return baseline_metrics(spark, d).withColumns(
        {c: steady(F.col(c)) for c in ("mae", "rmse", "r2", "mean_error", "median_absolute_error")})


_PER = f"""{BASELINE_SQL},
metrics AS (SELECT model, target, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse FROM errors GROUP BY 1, 2)"""


@query("metric_rank", f"{WITH}, {_PER} SELECT model, target, rank() OVER (PARTITION BY target ORDER BY mae) AS rank FROM metrics")
def metric_rank(spark, d):
    return M.metric_rank(baseline_metrics(spark, d)).select("model", "target", "rank")


@query("best_models", f"""{WITH}, {_PER}
SELECT target, model, {R4.format('mae')} AS mae FROM metrics
QUALIFY row_number() OVER (PARTITION BY target ORDER BY mae, rmse, model) = 1""")
def best_models(spark, d):
    return M.best_models(baseline_metrics(spark, d)).select("target", "model", steady(F.col("mae")).alias("mae"))


@query("improvement", f"""{WITH}, {_PER}
SELECT a.target, {R4.format('(b.mae - a.mae) / b.mae * 100')} AS improvement_pct FROM metrics a JOIN metrics b
  ON a.target = b.target AND a.model = 'Previous Performance' AND b.model = 'Train Mean'""")
def improvement(spark, d):
    metrics = baseline_metrics(spark, d)
    gain = M.improvement(metrics.where("model = 'Previous Performance'"), metrics.where("model = 'Train Mean'"))
    return gain.select("target", steady(F.col("improvement_pct")).alias("improvement_pct"))


@query("metric_pivot", f"""{WITH}, {_PER}
SELECT target, {R4.format("max(CASE WHEN model = 'Train Mean' THEN mae END)")} AS train_mean,
  {R4.format("max(CASE WHEN model = 'Previous Performance' THEN mae END)")} AS previous_performance FROM metrics GROUP BY 1""")
def metric_pivot(spark, d):
    wide = M.metric_pivot(baseline_metrics(spark, d), ("Train Mean", "Previous Performance"))
    return wide.select("target", steady(F.col("Train Mean")).alias("train_mean"),
                       steady(F.col("Previous Performance")).alias("previous_performance"))


_PREVIOUS = f"{BASELINE_SQL}, mine AS (SELECT * FROM errors WHERE model = 'Previous Performance')"


def previous(spark, d):
    return baseline(spark, d).where("model = 'Previous Performance'")


@query("error_percentiles", f"""{WITH}, {_PREVIOUS}
SELECT target, max(abs(error)) AS max_error, {R4.format('avg(abs(error))')} AS mean_abs_error,
  {R4.format('avg(error)')} AS mean_error, {R4.format('stddev_pop(error)')} AS std_error,
  {", ".join(f"{R4.format(f'quantile_cont(abs(error), {p / 100})')} AS p{p}" for p in (50, 75, 90, 95, 99))}
FROM mine GROUP BY target""")
def error_percentiles(spark, d):
    return M.error_percentiles(previous(spark, d)).withColumns({c: steady(F.col(c)) for c in (
        "mean_abs_error", "mean_error", "std_error", "p50", "p75", "p90", "p95", "p99")})


@query("bias", f"""{WITH}, {_PREVIOUS}
SELECT target, {R4.format('avg(error)')} AS mean_error, {R4.format('avg(abs(error))')} AS mean_absolute_error,
  CASE WHEN avg(error) > 0 THEN 'OVERPREDICTION' WHEN avg(error) < 0 THEN 'UNDERPREDICTION' ELSE 'NEUTRAL' END AS direction
FROM mine GROUP BY target""")
def bias(spark, d):
    return M.bias(previous(spark, d)).withColumns({c: steady(F.col(c)) for c in ("mean_error", "mean_absolute_error")})


@query("distribution", f"""{WITH}, {_PREVIOUS}
SELECT target, {", ".join(f"{R4.format(f'avg({c})')} AS {c}_mean, {R4.format(f'stddev_samp({c})')} AS {c}_std, "
    f"{R4.format(f'min({c})')} AS {c}_min, {R4.format(f'max({c})')} AS {c}_max" for c in ("actual", "predicted"))}
FROM mine GROUP BY target""")
def distribution(spark, d):
    known = previous(spark, d).where("actual IS NOT NULL AND predicted IS NOT NULL")
    shown = M.distribution(known)
    return shown.select("target", *[steady(F.col(c)).alias(c) for c in shown.columns if c != "target"])


@query("total_consistency", f"""{WITH}, {SPLIT_SQL},
gaps AS (SELECT abs(previous_total - (previous_squat + previous_bench + previous_deadlift)) AS gap FROM supervised)
SELECT count(gap) AS predictions, {R4.format('avg(gap)')} AS mean_difference, {R4.format('max(gap)')} AS max_difference,
  count_if(gap <= 5) AS within_5, {R4.format('median(gap)')} AS median_difference,
  CASE WHEN avg(gap) <= 5 THEN 'GOOD' WHEN avg(gap) <= 15 THEN 'ACCEPTABLE' ELSE 'INDEPENDENT_TARGETS_DIFFER' END AS status
FROM gaps""")
def total_consistency(spark, d):
    wide = pinned(supervised(spark, d).select(*[F.col(p).alias(f"predicted_{t}") for t, p in _LAST.items()]))
    return M.total_consistency(wide).withColumns(
        {c: steady(F.col(c)) for c in ("mean_difference", "max_difference", "median_difference")})


# ---- request features -------------------------------------------------------------------------

def requests(spark, d):
    """Every athlete with a result before 2001 asks for 2001."""
    results = meet_results(spark, d)
    newest = results.where("year < 2001").groupBy("athlete_id").agg(F.max_by(
        F.struct("division", "weight_class", "equipment"), F.struct("year", "competition", "seq")).alias("r"))
    return newest.select(F.col("athlete_id").alias("request_id"), "athlete_id", F.lit(2001).alias("target_year"), "r.*")


_SHOWN = ("previous_year_count", "previous_year", "years_since_previous", "previous_squat", "historical_max_total")


@query("request_features", f"""{WITH}, {FEATURES_SQL},
latest AS (SELECT * FROM features WHERE year < 2001 QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY year DESC) = 1)
SELECT athlete_id AS request_id, CAST(2001 AS INTEGER) AS year, CASE previous_year_count WHEN 0 THEN 1 ELSE previous_year_count END
    AS previous_year_count, CASE previous_year_count WHEN 0 THEN year ELSE previous_year END AS previous_year,
  CASE previous_year_count WHEN 0 THEN 2001 - year ELSE years_since_previous END AS years_since_previous,
  CASE previous_year_count WHEN 0 THEN year_best_squat ELSE previous_squat END AS previous_squat,
  CASE previous_year_count WHEN 0 THEN year_total_max ELSE historical_max_total END AS historical_max_total FROM latest""")
def request_features(spark, d):
    return ML.request_features(requests(spark, d), meet_results(spark, d), athlete="athlete_id").select(
        "request_id", "year", *_SHOWN)


@query("request_features_as_of", f"""{WITH}, {FEATURES_SQL},
latest AS (SELECT *, max(year_total_max) OVER (PARTITION BY athlete_id) AS top FROM athlete_years WHERE year < 2001
  QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY year DESC) = 1)
SELECT athlete_id AS request_id, CAST(2001 AS INTEGER) AS year, year AS previous_year, 2001 - year AS years_since_previous,
  year_best_squat AS previous_squat, top AS historical_max_total FROM latest""")
def request_features_as_of(spark, d):
    return ML.request_features(requests(spark, d), meet_results(spark, d), "as_of_target", "athlete_id").select(
        "request_id", "year", *[c for c in _SHOWN if c != "previous_year_count"])


@query("request_guard", f"""{WITH}
SELECT c.c_custkey AS request_id, max(m.year) AS last_year, CASE WHEN max(m.year) IS NULL THEN 'NO_HISTORY'
  WHEN max(m.year) >= 2000 THEN 'HISTORY_REACHES_TARGET' ELSE 'ACCEPTED' END AS status
FROM customer c LEFT JOIN meet_results m ON m.athlete_name = 'CUSTOMER#' || lpad(CAST(c.c_custkey AS VARCHAR), 9, '0')
GROUP BY c.c_custkey""")
def request_guard(spark, d):
    """Every customer asks for 2000 and brings all results."""
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.lit(2000).alias("target_year"))
    history = meet_results(spark, d).select(
        F.regexp_extract("athlete_name", r"#0*(\d+)$", 1).cast("long").alias("request_id"), "year")
    return ML.guarded(asked, history).select("request_id", "last_year", "status")


# ---- models: no SQL states a fitted model; what follows from the rows alone is stated ------------

_FITTED: dict = {}
_JUDGED = f"""{SPLIT_SQL},
whole AS (SELECT * FROM supervised WHERE {" AND ".join(f"{t} IS NOT NULL" for t in TARGETS)}),
target(target) AS (VALUES {", ".join(f"('{t}')" for t in TARGETS)}),
asking AS (SELECT DISTINCT athlete_id FROM meet_results WHERE year < 2001)"""


def _models(spark, d):
    """All candidates on all targets, fitted once for a session and the files of a folder: several queries read the same models."""
    key = (spark.sparkContext.applicationId, file_stamp(spark, d))
    if key not in _FITTED:
        keep = ("seq", "athlete_id", "split", *PRODUCTION_FEATURES, *TARGETS, *_LAST.values())
        keep = tuple(dict.fromkeys(keep))
        _FITTED[key] = ML.session_models(spark, pinned(supervised(spark, d).select(*keep)))
    return _FITTED[key]


def _kept(spark, d, name, make):
    """What ``make`` returns, found once for a session and the files of a folder."""
    key = (name, spark.sparkContext.applicationId, file_stamp(spark, d))
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _predicted(prepared, fitted):
    """Long predictions, made once: every reader finds the predictions written."""
    return pinned(ML.long_predictions(prepared.select("features", *TARGETS), fitted))


def _judged(spark, d):
    """Errors of all models on the validation years, a row for each model and target."""
    def make():
        _, fitted, prepared = _models(spark, d)
        return pinned(M.error_metrics(_predicted(prepared.where("split = 'validation'"), fitted)))
    return _kept(spark, d, "judged", make)


@query("model_comparison")
def model_comparison(spark, d):
    return _judged(spark, d)


def _chosen(spark, d):
    """Model name per target with the least validation error: four rows, asked for once."""
    return _kept(spark, d, "chosen", lambda: {
        r["target"]: r["model"] for r in M.best_models(_judged(spark, d)).collect()})


def _production(spark, d):
    prep, fitted, _ = _models(spark, d)
    return ML.production_models(prep, fitted, _chosen(spark, d))


def _tested(spark, d):
    """Predictions of the chosen models for the test years."""
    def make():
        _, fitted, prepared = _models(spark, d)
        return _predicted(prepared.where("split = 'test'"), {(m, t): fitted[(m, t)] for t, m in _chosen(spark, d).items()})
    return _kept(spark, d, "tested", make)


def _asked(spark, d):
    """Every request with its features and what the chosen models predict for it."""
    def make():
        rows = ML.request_features(requests(spark, d), meet_results(spark, d), athlete="athlete_id")
        return pinned(ML.predict(rows, _production(spark, d)))
    return _kept(spark, d, "asked", make)


@query("test_evaluation")
def test_evaluation(spark, d):
    """Test-year errors of the chosen models and of last year's result, and by how much the models are better."""
    _, _, prepared = _models(spark, d)
    last = M.baseline_predictions(prepared.where("split <> 'validation'").select("split", *TARGETS, *_LAST.values())).where(
        "model = 'Previous Performance'")
    # four rows each, which are read twice
    chosen, baseline_ = pinned(M.error_metrics(_tested(spark, d))), pinned(M.error_metrics(pinned(last)))
    gain = M.improvement(chosen, baseline_)
    return chosen.join(baseline_.select("target", F.col("mae").alias("baseline_mae"), F.col("rmse").alias("baseline_rmse")),
                       "target").join(gain.select("target", "improvement_pct"), "target")


@query("model_predictions")
def model_predictions(spark, d):
    return _asked(spark, d).select("request_id", *[f"predicted_{t}" for t in TARGETS])


@query("prediction_report")
def prediction_report(spark, d):
    return ML.prediction_report(_asked(spark, d), _tested(spark, d), ("request_id",))


def _projected(spark, d):
    """Every result's class field with what its athlete is predicted for 2001."""
    field = meet_results(spark, d).select("seq", "athlete_id", "weight_class", "year", "total")
    return ML.field_projection(field, _asked(spark, d).drop("weight_class", "year"), ("athlete_id",))


@query("field_projection")
def field_projection(spark, d):
    return PO.leaderboard(_projected(spark, d), ("weight_class", "year"))


@query("stored_models", f"""{WITH}, {_JUDGED}
SELECT count(*) AS rows, {", ".join(f"0.0::DOUBLE AS max_predicted_{t}" for t in TARGETS)}, true AS equal FROM asking""")
def stored_models(spark, d):
    rows = _asked(spark, d)
    path = fresh_folder(spark, "models")
    ML.save_models(_production(spark, d), path)
    columns = [f"predicted_{t}" for t in TARGETS]
    again = ML.predict(rows.drop(*columns), ML.load_models(path))
    return M.prediction_difference(rows, again, ("request_id",), columns)


def _sound(*columns):
    """Values are there and finite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce(out, F.lit(False))


@query("model_checks", f"""{WITH}, {_JUDGED},
judged AS (SELECT split, count(*) AS n FROM whole GROUP BY split)
SELECT 'comparison' AS part, model || ' ' || target AS subject, (SELECT n FROM judged WHERE split = 'validation') AS n, true AS sound
FROM target, (VALUES ('Ridge'), ('ElasticNet'), ('Random Forest'), ('Extra Trees'), ('Gradient Boosting')) AS m(model)
UNION ALL SELECT 'test', target, (SELECT n FROM judged WHERE split = 'test'), true FROM target
UNION ALL SELECT 'predictions', 'requests', (SELECT count(*) FROM asking), true
UNION ALL SELECT 'report', target, (SELECT count(*) FROM asking), true FROM target
UNION ALL SELECT 'projection', CASE WHEN a.athlete_id IS NULL THEN 'Historical benchmark' ELSE 'AI prediction if competing' END,
  count(*), true FROM meet_results m LEFT JOIN asking a USING (athlete_id) GROUP BY 2""")
def model_checks(spark, d):
    """How many rows each part of the model work judges or answers, and whether its values hold what they must.

    A comparison is sound if its errors are finite and the model is right within the spread of its target; a test if its gain
    follows from the two errors; predictions if they are finite; a projection if it is the prediction or the total.
    """
    spread = _models(spark, d)[2].agg(*[(F.max(t) - F.min(t)).alias(t) for t in TARGETS]).unpivot(
        [], list(TARGETS), "target", "spread")
    compared = model_comparison(spark, d).join(spread, "target").select(
        F.lit("comparison").alias("part"), F.concat_ws(" ", "model", "target").alias("subject"), "n",
        (_sound("mae", "rmse", "median_absolute_error") & (F.col("mae") <= F.col("rmse")) & (F.col("rmse") < F.col("spread"))).alias("sound"))
    gain = (F.col("baseline_mae") - F.col("mae")) / F.col("baseline_mae") * 100
    tested = test_evaluation(spark, d).select(
        F.lit("test"), "target", "n", _sound("mae", "rmse", "improvement_pct") & (F.abs(gain - F.col("improvement_pct")) < 1e-9))
    names = [f"predicted_{t}" for t in TARGETS]
    predicted = model_predictions(spark, d).agg(F.count(F.lit(1)).alias("n"), F.bool_and(_sound(*names)).alias("sound")).select(
        F.lit("predictions"), F.lit("requests"), "n", "sound")
    report = prediction_report(spark, d).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.bool_and(
        _sound("prediction_kg", "historical_mae_kg") & (F.col("historical_p90_error_kg") >= 0)).alias("sound")).select(
        F.lit("report"), "target", "n", "sound")
    projected = _projected(spark, d).groupBy("projection_source").agg(F.count(F.lit(1)).alias("n"), F.bool_and(
        F.col("projected_total").eqNullSafe(F.coalesce("ai_predicted_total", "total"))).alias("sound")).select(
        F.lit("projection"), "projection_source", "n", "sound")
    out = compared
    for part in (tested, predicted, report, projected):
        out = out.union(part)
    return out


def _searched(spark, d):
    """Draws and their cross-validated errors on all targets, and the best draws fitted; found once for the files of a folder."""
    key = ("search", spark.sparkContext.applicationId, file_stamp(spark, d))
    if key not in _FITTED:
        rows = ML.complete_rows(pinned(supervised(spark, d).select("split", *PRODUCTION_FEATURES, *TARGETS)))
        train = rows.where("split = 'train'")
        prep = ML.prepare(train)
        learned = pinned(prep.transform(train).select("features", *TARGETS))
        scores, best = {}, {}
        for name, space in ML.TUNING.items():
            draws = [ML.Boosting(**choice) for choice in ML.sampled_grid(space)]
            scores[name] = ML.search(learned, draws)
            best |= ML.tuned(learned, draws, scores[name], name)
        _FITTED[key] = scores, best, prep.transform(rows.where("split = 'validation'"))
    return _FITTED[key]


@query("tuned_models")
def tuned_models(spark, d):
    """Random search for boosting on all targets: 20 draws from the full space, on 5 folds; validation errors of the best draws.

    Every fit, of the search too, learns from all labelled rows (of its folds).
    """
    _, best, judged = _searched(spark, d)
    return M.error_metrics(_predicted(judged, best))


@query("search_scores", f"""{WITH}, {_JUDGED}
SELECT 'Gradient Boosting' AS model, target, 20::BIGINT AS draws, 20::BIGINT AS ranks, true AS ordered FROM target""")
def search_scores(spark, d):
    """Of each target of the search how many draws have a mean error over the folds, and whether their ranks follow it."""
    out = None
    for name, scores in _searched(spark, d)[0].items():
        part = scores.groupBy("target").agg(
            F.count_if(F.col("cv_mae") > 0).alias("draws"), F.countDistinct("rank").alias("ranks"),
            (F.min_by("cv_mae", "rank") == F.min("cv_mae")).alias("ordered")).select(F.lit(name).alias("model"), "*")
        out = part if out is None else out.unionByName(part)
    return out
