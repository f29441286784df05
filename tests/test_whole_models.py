"""Models learn from all labelled rows, whatever their number, and neither rows nor trees pass the driver."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlake.plans import models as ML
from meetlake.plans import trees as T
from meetlake.plans.queries import models as MQ
from meetlake.plans.trees import Boosting, Forest
from meetlake.schema import PRODUCTION_FEATURES, TARGETS


def labelled(spark, n):
    """Rows of the training years: features and targets that follow from the row's number."""
    number = F.col("seq") % 97
    numbers = [(number * (k + 1) % 31).cast("double").alias(c) for k, c in enumerate(ML.NUMERIC)]
    names = [F.concat(F.lit(c), (F.col("seq") % 3).cast("string")).alias(c) for c in ML.CATEGORICAL]
    targets = [(number * 2.0 + F.col("seq") % (k + 5)).alias(t) for k, t in enumerate(TARGETS)]
    return spark.range(n).withColumnRenamed("id", "seq").select("seq", F.lit("train").alias("split"), *numbers, *names, *targets)


def test_the_number_of_rows_cuts_no_model(spark):
    rows = labelled(spark, 300).cache()
    learned = []
    for most in (20, 1000):
        _, fitted, _ = ML.session_models(spark, rows, most, "seq", ("Ridge",))
        learned.append([(list(m.coefficients), m.intercept) for m in fitted.values()])
    assert learned[0] == learned[1]


def test_all_candidates_and_the_search_read_all_rows(spark, monkeypatch, tmp_path):
    seen = {}

    def taken(name, found):
        def run(rows, *_):
            seen[name] = rows.count()
            return found
        return run

    monkeypatch.setattr(MQ, "supervised", lambda spark, d: labelled(spark, 21_000).withColumns({c: F.lit(0.0) for c in ("athlete_id",)}))
    monkeypatch.setattr(ML, "search", taken("search", None))
    monkeypatch.setattr(ML, "tuned", taken("best draws", {}))
    monkeypatch.setattr(ML, "fit_all", taken("candidates", {}))
    MQ._searched(spark, str(tmp_path))
    assert set(PRODUCTION_FEATURES) <= set(labelled(spark, 1).columns)
    MQ._models(spark, str(tmp_path))
    assert seen == {"search": 21_000, "best draws": 21_000, "candidates": 21_000}


def test_neither_rows_nor_trees_pass_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(150, 3)), rng.integers(0, 2, (150, 2))), axis=1)
    rows = spark.createDataFrame([([float(v) for v in a], float(a[0] * 3 + a[3])) for a in x], "x array<double>, total double").select(
        array_to_vector("x").alias("features"), "total").repartition(3)
    models = {"Random Forest": Forest(trees=25), "Extra Trees": Forest(trees=5, share="all", random_cuts=True),
              "Gradient Boosting": Boosting(rounds=4)}

    def refused(*_, **__):
        raise AssertionError("sent or fetched by the driver")

    with monkeypatch.context() as m:
        for of, name in ((DataFrame, "collect"), (DataFrame, "toArrow"), (DataFrame, "toPandas"), (DataFrame, "toLocalIterator"),
                         (SparkContext, "broadcast")):
            m.setattr(of, name, refused)
        fitted = ML.fit_all(rows, models, ["total"])
        long = ML.long_predictions(rows, fitted)
        one = fitted["Random Forest", "total"].transform(rows).select("total", "predicted")
    # the same trees as of a table by itself, and the same sums
    table = T.Table.of(rows, ["total"])
    grown = {"Random Forest": (0.0, 1 / 25, [t for b in (0, 1) for t in T.forest_trees(table, 0, models["Random Forest"], b, ML.SEED)]),
             "Extra Trees": (0.0, 1 / 5, list(T.forest_trees(table, 0, models["Extra Trees"], 0, ML.SEED)))}
    base, rounds = 0.0, []
    for base, tree, _ in T.boosted(table, 0, models["Gradient Boosting"], ML.SEED):
        rounds.append(tree)
    grown["Gradient Boosting"] = base, 1.0, rounds
    found = long.collect()
    assert len(found) == 450
    for name, (base, scale, all_trees) in grown.items():
        walks = [T.walk(*(np.asarray(v) for v in (t.feature, t.threshold, t.left, t.value))) for t in all_trees]
        wanted = base + scale * T.walked(table.x, T.abreast(walks))
        got = sorted((r["actual"], r["predicted"]) for r in found if r["model"] == name)
        assert np.allclose(got, sorted(zip(table.y[:, 0], wanted)), rtol=1e-12, atol=0)
    assert sorted(map(tuple, one.collect())) == sorted((r["actual"], r["predicted"]) for r in found if r["model"] == "Random Forest")


def test_blocks_hold_their_rows():
    x = np.array([[0.0, 1.5, 1.0], [1.0, np.nan, 1.0], [0.0, -np.inf, 0.0]])
    flags, packed = T._pack(x)
    assert list(flags) == [1, 0, 1]
    back = T._unpack({"n": 3, "flags": flags, "packed": packed}, np.empty((3, 3)))
    assert np.array_equal(back.T, x, equal_nan=True)
    block = {"n": 3, "flags": flags, "packed": packed, "held": np.arange(3.0).tobytes()}
    other = {"n": 1, "flags": bytes(3), "packed": np.zeros(3).tobytes(), "held": np.array([9.0]).tobytes()}
    table = T.Table.joined([other | {"part": 1, "number": 0}, block | {"part": 0, "number": 1}], ["t"])
    assert table.y[:, 0].tolist() == [0, 1, 2, 9] and np.array_equal(table.x[:3], x, equal_nan=True)


def test_stored_trees_walk_as_grown():
    rng = np.random.default_rng(4)
    table = T.Table(rng.random((300, 4)), rng.random((300, 1)), ["t"])
    for model in (Forest(trees=3), Forest(trees=3, share="all", random_cuts=True), Forest(trees=2, min_rows=400)):
        for tree in T.forest_trees(table, 0, model, 0, 1):
            for a, b in zip(T.walk(*(np.asarray(v) for v in (tree.feature, tree.threshold, tree.left, tree.value))),
                            T._walk_of(*T._stored(tree))):
                assert np.array_equal(a, b)


@pytest.mark.parametrize("size", [1, 3000, 1 << 30])
def test_sums_do_not_depend_on_the_bundles(monkeypatch, size):
    rng = np.random.default_rng(5)
    table = T.Table(rng.random((200, 3)), rng.random((200, 1)) * 1e3, ["t"])
    trees = pa.RecordBatch.from_pylist([
        {"model": 0, "base": 0.0, "scale": 1 / 30, "number": n, "feature": f, "mark": m}
        for n, (f, m) in enumerate(T._stored(t) for b in (0, 1) for t in T.forest_trees(table, 0, Forest(trees=30), b, 2))])
    flags, packed = T._pack(table.x)
    block = {"part": 0, "number": 0, "n": 200, "flags": flags, "packed": packed, "held": np.arange(200).tobytes()}

    def found(bundles):
        pairs = [pa.RecordBatch.from_pylist([block | b for b in some]) for some in bundles]
        sums = [s for p in pairs for s in T._block_sums(iter([p]))]
        return np.concatenate([b.column("_predicted").to_numpy() for b in T._whole_sums(iter(sums))])

    whole = found([[r for b in T._bundles(iter([trees])) for r in b.to_pylist()]])
    monkeypatch.setattr(T, "BUNDLE", size)
    dealt = [r for b in T._bundles(iter([trees])) for r in b.to_pylist()]
    assert sum(b["trees"] for b in dealt) == 30
    assert np.array_equal(found([[b] for b in reversed(dealt)]), whole)
