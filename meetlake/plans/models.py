"""Next-performance models: preparation, candidates, selection, tuning, storage and batch prediction.

Preparation and linear models are MLlib's; tree ensembles are fitted side by side, in one Spark job, from all labelled rows
(``trees.py``). The driver only holds the parameters of linear models and of the preparation.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.operators.metrics import error_percentiles
from meetlake.operators.temporal import athlete_year, temporal_features
from meetlake.plans import trees
from meetlake.plans.trees import Boosting, Forest
from meetlake.schema import (
    HISTORY_FEATURES, PRODUCTION_FEATURES, TARGETS, forbid_columns, require_columns,
)

CATEGORICAL = ("division", "weight_class", "equipment")
NUMERIC = tuple(f for f in PRODUCTION_FEATURES if f not in CATEGORICAL)
SEED = 42
# fixed values: what the search draws from
TUNING = {"Gradient Boosting": {"rounds": (100, 200, 300, 500), "rate": (0.01, 0.03, 0.05, 0.1), "depth": (2, 3, 4, 5),
                                "min_rows": (2, 3, 5, 10), "subsample": (0.7, 0.85, 1.0), "loss": ("squared_error", "huber")}}


def preparation(train: DataFrame) -> list:
    """Stages: most frequent category and median in place of missing values, one-hot, scaling.

    The most frequent categories come from the training rows; everything is stored with the model.
    """
    forbid_columns(PRODUCTION_FEATURES, (*TARGETS, "bodyweight"))
    require_columns(train, PRODUCTION_FEATURES)
    common = train.agg(*[F.mode(c).alias(c) for c in CATEGORICAL]).first()

    def literal(v) -> str:
        return "'" + str("" if v is None else v).replace("'", "''") + "'"

    filled = ", ".join(f"coalesce(CAST({c} AS STRING), {literal(common[c])}) AS {c}_f" for c in CATEGORICAL)
    numbers = ", ".join(f"CAST({c} AS DOUBLE) AS {c}_n" for c in NUMERIC)
    return [
        SQLTransformer(statement=f"SELECT *, {filled}, {numbers} FROM __THIS__"),
        Imputer(strategy="median", inputCols=[f"{c}_n" for c in NUMERIC], outputCols=[f"{c}_i" for c in NUMERIC]),
        StringIndexer(inputCols=[f"{c}_f" for c in CATEGORICAL], outputCols=[f"{c}_x" for c in CATEGORICAL],
                      handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_x" for c in CATEGORICAL], outputCols=[f"{c}_h" for c in CATEGORICAL],
                      dropLast=False, handleInvalid="keep"),
        VectorAssembler(inputCols=[f"{c}_i" for c in NUMERIC], outputCol="numbers"),
        StandardScaler(withMean=True, inputCol="numbers", outputCol="scaled"),
        VectorAssembler(inputCols=["scaled", *[f"{c}_h" for c in CATEGORICAL]], outputCol="features"),
    ]


def prepare(train: DataFrame) -> PipelineModel:
    return Pipeline(stages=preparation(train)).fit(train)


def candidates(rows: int) -> dict[str, object]:
    """Candidate regressors; ``rows`` scales the ridge penalty."""
    common = dict(featuresCol="features", labelCol="label", predictionCol="predicted")
    return {
        "Ridge": LinearRegression(regParam=10.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, **common),
        "ElasticNet": LinearRegression(regParam=0.01, elasticNetParam=0.5, maxIter=200, standardization=False, **common),
        "Random Forest": Forest(trees=500, share="sqrt", min_rows=2),
        "Extra Trees": Forest(trees=500, share="all", min_rows=2, random_cuts=True),
        "Gradient Boosting": Boosting(rounds=300, rate=0.03, depth=3, min_rows=3, loss="huber"),
    }


def complete_rows(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=list(TARGETS))


def _in_parallel(jobs: Sequence, work, width: int = 4) -> list:
    """Submit independent fits side by side; Spark schedules their stages."""
    with ThreadPool(min(width, max(len(jobs), 1))) as pool:
        return pool.map(inheritable_thread_target(work), jobs)


def fit_all(prepared_train: DataFrame, models: Mapping[str, object], targets: Sequence[str] = TARGETS) -> dict:
    """Fitted model per (model name, target) on all prepared training rows."""
    ensembles = {n: m for n, m in models.items() if isinstance(m, (Forest, Boosting))}
    jobs = [(m, t) for m in models if m not in ensembles for t in targets]

    def fit(job):
        name, target = job
        return job, models[name].copy().fit(prepared_train.withColumn("label", F.col(target)))

    fitted = dict(_in_parallel(jobs, fit))
    if ensembles:
        fitted |= trees.tree_models(trees.Rows.of(prepared_train, targets), ensembles, targets, SEED)
    return fitted


def long_predictions(prepared: DataFrame, fitted: Mapping[tuple[str, str], object], keep: Sequence[str] = ()) -> DataFrame:
    """Predictions of every fitted model as model, target, actual, predicted. The rows are written once for all models."""
    rows = trees.keyed(prepared.select(*dict.fromkeys((*keep, "features", *(t for _, t in fitted)))))
    grown = {key: model for key, model in fitted.items() if isinstance(model, trees.TreeModel)}
    parts = [model.transform(rows).select(*keep, F.lit(name).alias("model"), F.lit(target).alias("target"),
                                          F.col(target).alias("actual"), "predicted")
             for (name, target), model in fitted.items() if (name, target) not in grown]
    if grown:
        # all trees walk in one job
        asked = F.explode(F.array(*[F.struct(F.lit(n).alias("_model"), F.lit(name).alias("model"), F.lit(target).alias("target"),
                                             F.col(target).alias("actual")) for n, (name, target) in enumerate(grown)]))
        found = rows.select("_at", *keep, asked.alias("asked")).select("_at", *keep, "asked.*").join(
            trees.predictions(rows, list(grown.values())), ["_at", "_model"], "left")
        parts.append(found.select(*keep, "model", "target", "actual", F.coalesce("_predicted", F.lit(0.0)).alias("predicted")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sampled_grid(space: Mapping[str, Sequence], draws: int = 20, seed: int = SEED) -> list[dict]:
    """Distinct random parameter combinations of a search space."""
    rng, seen = random.Random(seed), {}
    sizes = 1
    for values in space.values():
        sizes *= len(values)
    while len(seen) < min(draws, sizes):
        choice = {k: rng.choice(v) for k, v in space.items()}
        seen[tuple(choice.items())] = choice
    return list(seen.values())


def search(prepared_train: DataFrame, draws: Sequence[Boosting], targets: Sequence[str] = TARGETS, folds: int = 5) -> DataFrame:
    """(target, draw, cv_mae, rank): mean error over shuffled folds of every draw, the best draw of a target first.

    All fits are one Spark job, each over all given rows.
    """
    scores = trees.staged_scores(trees.Rows.of(prepared_train, targets), draws, folds, SEED)
    mean = scores.groupBy("target", "draw").agg(F.avg("mae").alias("cv_mae"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("cv_mae", "draw")))


def tuned(prepared_train: DataFrame, draws: Sequence[Boosting], found: DataFrame, name: str) -> dict:
    """The best draw of each target, fitted on all given rows, by (name, target)."""
    best = {r["target"]: draws[r["draw"]] for r in found.where("rank = 1").collect()}  # one row a target
    rows = trees.Rows.of(prepared_train, list(best))
    fitted = trees.fitted_trees(rows, [(draw, n) for n, draw in enumerate(best.values())], SEED)
    return {(name, target): trees.TreeModel(fitted.where(F.col("job") == n)) for n, target in enumerate(best)}


# ---- production models ------------------------------------------------------------------------

def production_models(prep: PipelineModel, fitted: Mapping[tuple[str, str], object],
                      chosen: Mapping[str, str]) -> dict[str, PipelineModel]:
    """One pipeline per target from the shared preparation and the chosen candidate."""
    return {t: PipelineModel(stages=[*prep.stages, fitted[(m, t)]]) for t, m in chosen.items()}


def save_models(models: Mapping[str, PipelineModel], path: str) -> None:
    for target, model in models.items():
        model.write().overwrite().save(f"{path}/{target}")


def load_models(path: str, targets: Sequence[str] = TARGETS) -> dict[str, PipelineModel]:
    return {t: PipelineModel.load(f"{path}/{t}") for t in targets}


def predict(rows: DataFrame, models: Mapping[str, PipelineModel], prefix: str = "predicted_") -> DataFrame:
    """Add one prediction column per target to rows that carry the 22 features."""
    require_columns(rows, PRODUCTION_FEATURES)
    columns = list(rows.columns)
    for target, model in models.items():
        rows = model.transform(rows).select(*columns, F.col("predicted").alias(f"{prefix}{target}"))
        columns.append(f"{prefix}{target}")
    return rows


def prediction_report(predicted: DataFrame, test_predictions: DataFrame, key: Sequence[str],
                      prefix: str = "predicted_") -> DataFrame:
    """Predictions by target with the MAE and 90th percentile error of the test years."""
    reference = error_percentiles(test_predictions, (0.9,)).select(
        "target", F.col("mean_abs_error").alias("historical_mae_kg"), F.col("p90").alias("historical_p90_error_kg"))
    long = predicted.select(*key, *[F.col(f"{prefix}{t}").alias(t) for t in TARGETS]).unpivot(
        list(key), list(TARGETS), "target", "prediction_kg")
    return long.join(reference, "target", "left")


# ---- feature rows for requests ----------------------------------------------------------------

def history_violations(requests: DataFrame, history: DataFrame, athlete: str = "resolved_athlete_id") -> DataFrame:
    """Request histories that reach into or beyond the target year."""
    return requests.join(history.select(athlete, "year"), athlete).where(F.col("year") >= F.col("target_year"))


def guarded(requests: DataFrame, history: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests that bring their own history (rows by request) with last_year and a status: ACCEPTED, NO_HISTORY, or
    HISTORY_REACHES_TARGET if any row is not strictly before the target year. A missing target year or key is REJECTED."""
    last = history.groupBy(key).agg(F.max("year").alias("last_year"))
    return requests.join(last, key, "left").withColumn(
        "status", F.when(F.col(key).isNull() | F.col("target_year").isNull(), "REJECTED").when(
            F.col("last_year").isNull(), "NO_HISTORY").when(
            F.col("last_year") >= F.col("target_year"), "HISTORY_REACHES_TARGET").otherwise("ACCEPTED"))


def answered(requests: DataFrame, history: DataFrame, models: Mapping[str, PipelineModel], key: str = "request_id",
             mode: str = "reference") -> DataFrame:
    """Every request with its status and the four predictions, which only accepted ones have."""
    judged = guarded(requests, history, key)
    accepted = judged.where("status = 'ACCEPTED'").withColumn("request_id", F.col(key))
    own = history.join(accepted.select(key), key, "left_semi").withColumn("request_key", F.col(key))
    rows = request_features(accepted.withColumn("request_key", F.col(key)), own, mode, "request_key")
    found = predict(rows, models).select(F.col("request_id").alias(key), *[f"predicted_{t}" for t in models])
    return judged.join(found, key, "left")


def _through_year(years: DataFrame, athlete: str) -> DataFrame:
    """History features that include the row's own year."""
    line = Window.partitionBy(athlete).orderBy("year")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("year_total_mean").over(line)
    change = F.col("year_total_mean") - before
    return years.select(
        athlete, "year", F.row_number().over(line).alias("previous_year_count"), F.col("year").alias("previous_year"),
        F.col("year_total_mean").alias("previous_total"), F.col("year_best_squat").alias("previous_squat"),
        F.col("year_best_bench").alias("previous_bench"), F.col("year_best_deadlift").alias("previous_deadlift"),
        F.col("year_bodyweight_mean").alias("previous_bodyweight"),
        F.avg("year_total_mean").over(upto).alias("historical_mean_total"),
        F.max("year_total_max").over(upto).alias("historical_max_total"),
        F.min("year_total_min").over(upto).alias("historical_min_total"),
        F.stddev_samp("year_total_mean").over(upto).alias("historical_std_total"),
        F.max("year_best_squat").over(upto).alias("historical_max_squat"),
        F.max("year_best_bench").over(upto).alias("historical_max_bench"),
        F.max("year_best_deadlift").over(upto).alias("historical_max_deadlift"),
        F.avg("year_bodyweight_mean").over(upto).alias("historical_mean_bodyweight"),
        change.alias("previous_total_change"), (F.try_divide(change, before) * 100).alias("previous_total_change_pct"))


def request_features(requests: DataFrame, results: DataFrame, mode: str = "reference",
                     athlete: str = "resolved_athlete_id") -> DataFrame:
    """One feature row per request, from years strictly before its target year.

    ``requests`` holds request_id, the athlete, target_year, division, weight_class and equipment.
    In mode "reference" the row repeats the features of the athlete's latest year, which describe the
    time before that year; an athlete with a single year gets that year itself as history, with spread
    and change zero. In mode "as_of_target" the latest year always counts as history.
    """
    if mode not in ("reference", "as_of_target"):
        raise ValueError(f"unknown mode {mode}")
    years = athlete_year(results, athlete)
    through = _through_year(years, athlete)
    if mode == "reference":
        lagged = temporal_features(years, athlete).select(athlete, "year", *HISTORY_FEATURES)
        single = through.where("previous_year_count = 1").withColumns({
            "years_since_previous": F.lit(None).cast("int"), "historical_std_total": F.lit(0.0),
            "previous_total_change": F.lit(0.0), "previous_total_change_pct": F.lit(0.0)})
        feats = lagged.where("previous_year_count >= 1").withColumn("single", F.lit(False)).unionByName(
            single.select(athlete, "year", *HISTORY_FEATURES).withColumn("single", F.lit(True)))
    else:
        feats = through.withColumns({"years_since_previous": F.lit(None).cast("int"), "single": F.lit(True)}).select(
            athlete, "year", *HISTORY_FEATURES, "single")
    body = F.struct("single", *HISTORY_FEATURES)
    # requests meet an athlete's few years; the newest one before the target wins
    picked = requests.join(feats, athlete).where(F.col("year") < F.col("target_year")).groupBy(
        "request_id", athlete, "target_year", "division", "weight_class", "equipment").agg(
        F.max_by(body, "year").alias("f"))
    wide = picked.select("request_id", athlete, F.col("target_year").alias("year"), "division", "weight_class", "equipment",
                         "f.single", *[F.col(f"f.{c}").alias(c) for c in HISTORY_FEATURES])
    gap = F.when(F.col("single"), F.greatest(F.lit(0), F.col("year") - F.col("previous_year"))).otherwise(
        F.col("years_since_previous"))
    return wide.withColumn("years_since_previous", gap).drop("single")


def field_projection(field: DataFrame, predicted: DataFrame, key: Sequence[str], value: str = "predicted_total",
                     fallback: str = "total") -> DataFrame:
    """Projected total of each competitor: the prediction when there is one, else the historical total."""
    joined = field.join(predicted.select(*key, F.col(value).alias("ai_predicted_total")), list(key), "left")
    known = F.col("ai_predicted_total").isNotNull()
    return joined.withColumns({
        "projected_total": F.coalesce(F.col("ai_predicted_total"), F.col(fallback)),
        "projection_source": F.when(known, "AI prediction if competing").otherwise("Historical benchmark")})


def projection_failures(projected: DataFrame) -> DataFrame:
    return projected.agg(F.count(F.lit(1)).alias("competitors"),
                         F.count_if(F.col("ai_predicted_total").isNull()).alias("failures"))


def session_models(spark: SparkSession, supervised: DataFrame, _rows: int | None = None, _key: str | None = None,
                   names: Sequence[str] | None = None):
    """Preparation, fitted candidates and prepared splits of a supervised table with a split column.

    All complete training rows are learned from and all judged rows are kept. ``_rows`` and ``_key`` once bounded the training
    rows; they are taken for callers that still pass them, and change nothing.
    """
    rows = complete_rows(supervised)
    train = rows.where("split = 'train'")
    prep = prepare(train)
    wanted = candidates(train.count())
    if names is not None:
        wanted = {n: wanted[n] for n in names}
    learned = prep.transform(train).select("features", *TARGETS).persist()
    try:
        fitted = fit_all(learned, wanted)
    finally:
        learned.unpersist()
    return prep, fitted, prep.transform(rows)
