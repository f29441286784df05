"""Tree ensembles against plain cuts, and on rows whose truth is known."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from meetlake.plans import models as ML
from meetlake.plans import trees as T
from meetlake.plans.trees import Boosting, Forest


def made(n=600, seed=0, errors=0.0):
    rng = np.random.default_rng(seed)
    x = np.concatenate((rng.normal(size=(n, 4)), rng.integers(0, 2, (n, 2))), axis=1)
    truth = 100 + 30 * (x[:, 0] > 0) + 20 * x[:, 1] + 10 * x[:, 4] * x[:, 2]
    noise = rng.normal(size=n) + np.where(rng.random(n) < errors, rng.choice([-600.0, 900.0], n), 0)
    return x, truth, truth + noise


def predictions(trees, x, base=0.0, scale=1.0):
    total = np.zeros(len(x))
    for t in trees:
        for r, row in enumerate(x):
            node = 0
            while t.feature[node] >= 0:
                node = t.left[node] + (row[t.feature[node]] > t.threshold[node])
            total[r] += t.value[node]
    return base + scale * total


def test_cut_is_the_best_of_all():
    x, _, y = made(60)
    table = T.Table(x, y[:, None], ["t"])
    goal, best = table.y[:, 0], (-1, None)
    for f in range(x.shape[1]):
        for edge in np.unique(table.x[:, f])[:-1]:
            left = table.x[:, f] <= edge
            if min(left.sum(), (~left).sum()) >= 5:
                gain = sum(goal[s].sum() ** 2 / s.sum() for s in (left, ~left)) - goal.sum() ** 2 / len(goal)
                best = max(best, (gain, f))
    rows = np.arange(60)
    gain, feature, _ = T.best_cuts(table, rows, np.zeros(60, np.int64), 1, goal, None, 5, None)
    assert gain[0] == pytest.approx(best[0]) and feature[0] == best[1]
    tree, node = T.grow(table, goal, np.random.default_rng(0), depth=1, min_rows=5)
    assert len(tree.feature) == 3 and np.bincount(node)[1:].min() >= 5
    assert ((table.x[:, tree.feature[0]] > tree.threshold[0]) + 1 == node).all()


def test_trees_grow_until_no_cut_is_left():
    x, _, y = made(400)
    table = T.Table(x, y[:, None], ["t"])
    for random in (False, True):
        tree, node = T.grow(table, table.y[:, 0], np.random.default_rng(1), min_rows=2, cuts_at_random=random)
        sizes = np.bincount(node, minlength=len(tree.feature))[np.array(tree.feature) < 0]
        assert sizes.min() >= 2 and sizes.max() <= 6 and sizes.sum() == 400


def test_extra_trees_differ_from_a_forest_and_both_learn():
    x, truth, y = made(500)
    table = T.Table(x[:400], y[:400, None], ["t"])
    found = {}
    for name, model in (("forest", Forest(trees=40)), ("extra", Forest(trees=40, share="all", random_cuts=True))):
        trees = [t for b in range(model.blocks()) for t in T.forest_trees(table, 0, model, b, 3)]
        assert len(trees) == 40
        found[name] = predictions(trees, x[400:], 0.0, 1 / 40)
        assert np.abs(found[name] - truth[400:]).mean() < 0.5 * np.abs(truth[400:] - y[:400].mean()).mean()
    assert np.abs(found["forest"] - found["extra"]).mean() > 0.5
    cuts = [t.threshold[0] for t in T.forest_trees(table, 0, Forest(trees=20, share="all", random_cuts=True), 0, 3)]
    assert len(set(cuts)) == 20 and not set(cuts) & set(table.edge.ravel())


def test_huber_loss_withstands_gross_errors():
    x, truth, y = made(900, 5, errors=0.05)
    table = T.Table(x[:600], y[:600, None], ["t"])
    error = {}
    for loss in ("huber", "squared_error"):
        base, found = 0.0, []
        for base, tree, predicted in T.boosted(table, 0, Boosting(rounds=120, rate=0.1, loss=loss), 1):
            found.append(tree)
        assert np.allclose(predicted, predictions(found, table.x, base))
        error[loss] = np.abs(predictions(found, x[600:], base) - truth[600:]).mean()
    assert error["huber"] < 0.7 * error["squared_error"]


def frame(spark, x, y):
    rows = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "x array<double>, total double")
    return rows.select(array_to_vector("x").alias("features"), "total").repartition(3)


def test_search_is_that_of_separate_fits(spark):
    """Draws that share a fit have the errors that they would have alone; the best is fitted and stored."""
    x, _, y = made(150)
    rows = frame(spark, x, y)
    draws = [Boosting(rounds=r, rate=0.1, depth=2, loss=loss, subsample=s) for r in (3, 9, 20) for loss, s in (("huber", 1.0), ("squared_error", 0.7))]
    got = {(r["draw"]): r["cv_mae"] for r in ML.search(rows, draws, ["total"], 3).collect()}
    table = T.Table.of(rows, ["total"])
    fold_of = np.random.default_rng(ML.SEED).permutation(150) % 3
    for n, draw in enumerate(draws):
        errors = []
        for fold in range(3):
            *_, (_, _, predicted) = T.boosted(table, 0, draw, ML.SEED, fold_of != fold)
            errors.append(np.abs(predicted - table.y[:, 0])[fold_of == fold].mean())
        assert got[n] == pytest.approx(np.mean(errors))
    found = ML.search(rows, draws, ["total"], 3)
    model = ML.tuned(rows, draws, found, "Boosting")["Boosting", "total"]
    assert model.trees.count() == draws[min(got, key=lambda n: (got[n], n))].rounds
    shown = model.transform(rows).agg(F.avg(F.abs(F.col("predicted") - F.col("total")))).first()[0]
    assert shown < min(got.values())


def test_stored_trees_predict_the_same(spark, tmp_path):
    from pyspark.ml import PipelineModel
    x, _, y = made(120)
    rows = frame(spark, x, y)
    fitted = ML.fit_all(rows, {"Random Forest": Forest(trees=30), "Extra Trees": Forest(trees=25, share="all", random_cuts=True),
                               "Gradient Boosting": Boosting(rounds=15)}, ["total"])
    assert len(fitted) == 3
    for (name, _), model in fitted.items():
        PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / name))
        again = PipelineModel.load(str(tmp_path / name))
        one, two = (sorted(m.transform(rows).select("predicted").collect()) for m in (model, again))
        assert one == two and len({r[0] for r in one}) > 10


def test_tables_without_rows(spark):
    rows = frame(spark, *[a[:0] for a in made(10)[::2]])
    assert ML.search(rows, [Boosting(rounds=2)], ["total"], 5).count() == 0


def test_few_rows_are_cut_as_many(monkeypatch):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.random((300, 6)) * 40), rng.random((300, 1))
    table = T.Table(x, y, ["t"])
    weight = rng.integers(0, 3, 300).astype(float)
    rows = np.flatnonzero(weight > 0)
    at = np.sort(rng.integers(0, 40, len(rows)))
    at = np.unique(at, return_inverse=True)[1]
    picks = rng.integers(0, 6, (at.max() + 1, 3))
    found = []
    for few in (0, 5, 1000):
        monkeypatch.setattr(T, "FEW", few)
        found.append([T.best_cuts(table, rows, at, at.max() + 1, table.y[:, 0], w, 2, picks) for w in (None, weight)])
    for other in found[1:]:
        for a, b in zip(found[0], other):
            cut = a[0] > -np.inf
            assert (a[0] == b[0]).all() and cut.any()
            assert (a[1][cut] == b[1][cut]).all() and (a[2][cut] == b[2][cut]).all()


def test_histograms_by_column_are_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    table = T.Table(rng.random((200, 5)), rng.random((200, 1)), ["t"])
    at, weight = rng.integers(0, 3, 200), rng.integers(1, 4, 200).astype(float)
    found = []
    for rows in (10**9, 0):
        monkeypatch.setattr(T, "COLUMN_ROWS", rows)
        found.append([T.best_cuts(table, np.arange(200), at, 3, table.y[:, 0], w, 2, None) for w in (None, weight)])
    assert all((p == q).all() for a, b in zip(*found) for p, q in zip(a, b))


def test_rows_walk_down_many_trees_at_once(monkeypatch):
    rng = np.random.default_rng(7)
    x, y = rng.random((400, 4)), rng.random((400, 1))
    table = T.Table(x, y, ["t"])
    trees = [t for b in range(2) for t in T.forest_trees(table, 0, Forest(trees=37), b, 1)]
    stump = T.Tree()
    stump.value = [0.25]
    trees.append(stump)
    asked, total = np.concatenate((rng.random((50, 4)), [[np.nan] * 4, [np.inf] * 4, [-np.inf] * 4])), np.zeros(53)
    for tree in trees:
        for row in range(53):
            node = 0
            while tree.feature[node] >= 0:
                node = tree.left[node] + int(asked[row, tree.feature[node]] > tree.threshold[node])
            total[row] += tree.value[node]
    walks = [T.walk(*(np.asarray(v) for v in (t.feature, t.threshold, t.left, t.value))) for t in trees]
    for abreast in (1, 5, 16):
        monkeypatch.setattr(T, "ABREAST", abreast)
        assert (T.walked(asked, T.abreast(walks)) == total).all()
    assert (T.walked(asked[:0], T.abreast(walks)) == total[:0]).all()


def test_predictions_are_made_once_for_all_queries(spark, monkeypatch, tmp_path):
    from meetlake.plans.queries import models as MQ
    prepared = spark.createDataFrame([("validation", 1.0, 2.0, 3.0, 4.0, 0.5)], ["split", *MQ.TARGETS, "features"])
    made = []

    def predictions(rows, fitted, keep=()):
        made.append(rows)
        return spark.createDataFrame([(m, t, 1.0, 1.0 + n) for n, m in enumerate(("a", "b")) for t in MQ.TARGETS],
                                     "model string, target string, actual double, predicted double")

    monkeypatch.setattr(MQ, "_models", lambda spark, d: (None, {}, prepared))
    monkeypatch.setattr(MQ.ML, "long_predictions", predictions)
    folder = str(tmp_path)
    assert MQ.model_comparison(spark, folder).count() == MQ.model_comparison(spark, folder).count() == 8
    assert MQ._chosen(spark, folder) == {t: "a" for t in MQ.TARGETS}
    assert len(made) == 1


def plain_cuts(table, rows, at, nodes, goal, min_rows):
    """Gain, feature and bin of the first best cut, every feature and bin added up by itself in the order of the rows."""
    out = []
    for node in range(nodes):
        mine, best = rows[at == node], (-np.inf, 0, 0)
        for f in range(table.x.shape[1]):
            sums, held = [0.0] * T.BINS, [0] * T.BINS
            for b, v in zip(table.bins[mine, f].tolist(), goal[mine].tolist()):
                sums[b], held[b] = sums[b] + v, held[b] + 1
            left, n, whole = np.cumsum(sums), np.cumsum(held), np.bincount(at[at == node] * 0, goal[mine])[0]
            for b in range(T.BINS - 1):
                if min_rows <= n[b] <= len(mine) - min_rows:
                    gain = left[b] * left[b] / n[b] + (whole - left[b])**2 / (len(mine) - n[b]) - whole * whole / len(mine)
                    best = max(best, (gain, f, b), key=lambda c: c[0])
        out.append(best)
    return [np.array(c) for c in zip(*out)]


def categories(n, seed=8):
    """Rows of values, a repeated and a constant column, and categories in a column each."""
    rng = np.random.default_rng(seed)
    values, of = np.round(rng.normal(size=(n, 3)) * 20), rng.integers(0, 30, n)
    x = np.concatenate((values, values[:, :1], np.zeros((n, 1)), rng.integers(0, 3, (n, 1)), of[:, None] == np.arange(30)), axis=1)
    return x, rng.normal(size=(n, 1)) * 50 + 20 * (of[:, None] < 9)


def test_categories_are_cut_as_by_plain_sums(monkeypatch):
    x, y = categories(240)
    # nodes of two categories, which either of them cuts alike
    x[:40, 6:] = np.eye(30)[np.arange(40) % 2]
    table = T.Table(x, y, ["t"])
    goal, rows = table.y[:, 0], np.arange(240)
    two = (table.x[:, 6] + table.x[:, 7]) > 0
    for at in (np.zeros(240, np.int64), np.where(two, 1, 0), np.arange(240) % 7, np.arange(240) // 6):
        for columns in (0, 10**9):
            monkeypatch.setattr(T, "COLUMN_ROWS", columns)
            gain, feature, cut = T.best_cuts(table, rows, at, at.max() + 1, goal, None, 2, None)
            wanted = plain_cuts(table, rows, at, at.max() + 1, goal, 2)
            known = wanted[0] > T.LEAST_GAIN
            assert known.any() and (feature[known] == wanted[1][known]).all() and (cut[known] == wanted[2][known]).all()
            assert gain == pytest.approx(wanted[0])


def test_categories_are_added_up_by_their_own_rows(monkeypatch):
    """A row is counted for the category that it is of, not for each that it is not of; columns that can't be cut cost nothing."""
    x, y = categories(2000)
    table, added, count = T.Table(x, y, ["t"]), [], np.bincount

    def bincount(values, *rest, **named):
        added.append(len(values))
        return count(values, *rest, **named)

    monkeypatch.setattr(T.np, "bincount", bincount)
    tree, _ = T.grow(table, table.y[:, 0], np.random.default_rng(0), depth=1)
    assert len(tree.feature) == 3 and sum(added) < 20 * 2000
