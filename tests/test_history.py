import random
from statistics import mean, stdev

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meetlake.operators import history as H
from meetlake.operators import temporal as T
from meetlake.operators.ordered import exact_percentiles, group_percentiles, in_parts, running_before
from meetlake.schema import PRODUCTION_FEATURES


def random_rows(n, seed, athletes="ABBBBBBC"):
    rng = random.Random(seed)
    kg = lambda: rng.choice([None, -100.0, 100.0, 110.0, 120.0, 130.0])
    return [dict(athlete_id=rng.choice(athletes), year=2000 + rng.randrange(4), competition=f"M{rng.randrange(4)}",
                 best_squat=kg(), best_bench=kg(), best_deadlift=kg(), total=kg(), squat_1=kg(), squat_2=kg(), squat_3=kg(),
                 bodyweight=rng.choice([60.0, 70.0])) for _ in range(n)]


def top(values):
    known = [v for v in values if v is not None]
    return max(known) if known else None


def test_examples_match_a_plain_walk(spark, results):
    """Both the single window and the chunked way; athlete B holds most rows."""
    rows = [dict(r, seq=i) for i, r in enumerate(random_rows(60, 3))]
    got = {r["seq"]: r for r in H.flat_examples(H.history_examples(results(*rows))).collect()}
    seen = 0
    for athlete in "ABC":
        mine = sorted((r for r in rows if r["athlete_id"] == athlete), key=lambda r: (r["year"], r["competition"], r["seq"]))
        for i, row in enumerate(mine):
            if i == 0:
                assert row["seq"] not in got
                continue
            g, past = got[row["seq"]], mine[:i]
            seen += 1
            assert g["previous_competition_count"] == i
            assert g["previous_best_squat"] == past[-1]["best_squat"] and g["previous_total"] == past[-1]["total"]
            assert g["historical_best_total"] == top(p["total"] for p in past)
            assert g["historical_best_squat_attempt"] == top(p[f"squat_{k}"] for p in past for k in (1, 2, 3))
            assert g["target_total"] == row["total"]
    assert seen == len(got)


def test_order_of_input_does_not_matter(results):
    rows = [dict(r, seq=i) for i, r in enumerate(random_rows(30, 5))]
    a = sorted(map(str, H.history_examples(results(*rows)).collect()))
    b = sorted(map(str, H.history_examples(results(*reversed(rows))).collect()))
    assert a == b


def test_missing_keys_are_refused(results):
    with pytest.raises(PySparkException):
        H.history_examples(results(dict(athlete_id=" "))).collect()
    assert H.rejected_history_keys(results(dict(athlete_id=" "), dict(year=None), {})).count() == 2


def test_leakage_matches_a_plain_walk(results):
    rows = [dict(r, seq=i) for i, r in enumerate(random_rows(80, 7, "AABC"))]
    sign = lambda r: (r["best_squat"], r["best_bench"], r["best_deadlift"], r["total"])
    examples = crowded = repeated = 0
    for athlete in "ABC":
        mine = sorted((r for r in rows if r["athlete_id"] == athlete), key=lambda r: (r["year"], r["competition"]))
        for i, r in enumerate(mine[1:], 1):
            examples += 1
            if sum((q["year"], q["competition"]) == (r["year"], r["competition"]) for q in mine) != 1:
                crowded += 1
            elif any(sign(q) == sign(r) for q in mine[:i]):
                repeated += 1
    got = H.leakage_audit(results(*rows)).first()
    assert (got["total_examples"], got["examples_with_target_in_history"], got["examples_with_target_values_in_history"]) == (
        examples, crowded, repeated)
    assert got["passed"] is False
    clean = H.leakage_audit(results(dict(year=2019, total=1.0), dict(year=2020, total=2.0))).first()
    assert clean["passed"] is True and clean["total_examples"] == 1


def test_yearly_features(results):
    rows = [dict(resolved_athlete_id="P", year=y, total=t, bodyweight=70.0) for y, t in
            ((2015, 500.0), (2015, 520.0), (2017, 540.0), (2018, None), (2019, 0.0), (2020, 600.0))]
    got = {r["year"]: r for r in T.temporal_features(T.athlete_year(results(*rows, dict(resolved_athlete_id=None)))).collect()}
    assert len(got) == 5
    assert got[2015]["previous_year_count"] == 0 and got[2015]["historical_mean_total"] is None
    assert (got[2017]["previous_total"], got[2017]["years_since_previous"], got[2017]["historical_std_total"]) == (510.0, 2, None)
    assert got[2018]["previous_total_change"] == 30.0 and got[2018]["historical_std_total"] == pytest.approx(stdev([510, 540]))
    assert got[2019]["previous_total"] is None and got[2019]["historical_mean_total"] == pytest.approx(mean([510, 540]))
    assert got[2020]["previous_total_change"] is None and got[2020]["historical_min_total"] == 0.0
    joined = T.supervised_dataset(results(*rows))
    assert joined.count() == 4
    assert T.production_features(joined).columns == list(PRODUCTION_FEATURES)
    with pytest.raises(ValueError, match="missing columns"):
        T.production_features(joined.drop("previous_total"))
    assert sum(v for k, v in T.chronology_check(joined).first().asDict().items() if k not in ("rows", "history_without_years")) == 0


@pytest.mark.parametrize("size", [1, 2, 9, 3000])
def test_percentiles_match_interpolation(spark, size):
    """Exact under a dominant value, with values of all signs and magnitudes and with few distinct ones."""
    import numpy as np
    rng = random.Random(size)
    wide = [rng.choice([5.0, 5.0, -0.0, 0.0, rng.random() * 100, -rng.random() * 1e-300, rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300)])
            for _ in range(size)]
    df = spark.createDataFrame([(v, None if i % 7 else v, round(v, 0) % 3, None) for i, v in enumerate(wide)], "a double, b double, c double, d double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["name"], r["prob"]): r["value"] for r in exact_percentiles(df, ("a", "b", "c", "d"), probs).collect()}
    assert len(got) == 15  # a column without values has none
    for name, column in (("a", wide), ("b", wide[::7]), ("c", [round(v, 0) % 3 for v in wide])):
        for p in probs:
            assert got[(name, p)] == pytest.approx(float(np.percentile(column, p * 100)), rel=1e-12)


def test_group_percentiles_by_radix(spark):
    """Groups of all sizes, a hot and a null one; no window, no sort of values in the plan."""
    import numpy as np
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "x", "y", None]), round(rng.gauss(0, 50), rng.choice([0, 1, 9]))) for _ in range(4000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = group_percentiles(df, "g", "v", (0.1, 0.5, 0.99))
    got = {(r["name"], r["prob"]): r["value"] for r in found.collect()}
    groups = {g: [v for k, v in rows if k == g and v is not None] for g in ("hot", "x", "y", None, "one")}
    assert got == {(g, p): pytest.approx(float(np.percentile(v, p * 100)), rel=1e-12) for g, v in groups.items() for p in (0.1, 0.5, 0.99)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan


def test_running_sum_chunks_agree(spark):
    rows = [("hot" if i % 3 else "cold", i // 40, i, float(i % 11)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, c int, i int, v double")
    measures = {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}
    one = running_before(df, ["k"], ["i"], measures).collect()
    many = running_before(df, ["k"], ["c", "i"], measures).collect()
    plain = {"hot": [], "cold": []}
    for k, _, i, v in rows:
        past = plain[k]
        got = next(r for r in many if r["i"] == i)
        assert (got["s"], got["n"], got["m"], got["l"]) == (sum(past), len(past), max(past, default=None), past[-1] if past else None)
        past.append(v)
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_scan_splits_one_group(spark, request):
    """A third of the rows and a single year belong to one athlete: parts stay small, and the carried state is right."""
    rows = [("hot", 2020, i, float((i * 37) % 101)) for i in range(3000)] + [(f"a{i % 900}", 2000 + i % 7, i, float(i)) for i in range(6000)] + [
        (None, 2020, i, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, year int, i int, v double").repartition(7)
    joined_parts = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joined_parts, "false")  # small parts would be put together again
    request.addfinalizer(lambda: spark.conf.unset(joined_parts))
    dealt = in_parts(df, ["k"], ["year", "i"])
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert max(sizes) < 0.3 * len(rows) and dealt.where("k = 'hot'").select("_part").distinct().count() > 1
    measures = {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "m": ("max", F.col("v")), "l": ("last", F.struct("v", "i"))}
    got = {(r["k"], r["year"], r["i"]): r for r in running_before(df, ["k"], ["year", "i"], measures).collect()}
    assert len(got) == len(rows)
    past = {}
    for k, year, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        n, s, m, last = past.get(k, (0, 0, None, None))
        r = got[k, year, i]
        assert (r["n"], r["s"], r["m"]) == (n, s, m) and (tuple(r["l"]) if r["l"] else None) == last
        past[k] = (n + 1, s + v, v if m is None else max(m, v), (v, i))
