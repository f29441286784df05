import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meetlake.operators import planning as P
from meetlake.operators import podium as PO


def ask(spark, *rows):
    base = dict(question_id="q", weight_class="66", target_year=2020, division="Open", equipment="raw", meet_tier="National", competition=None)
    filled = [{**base, **r} for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in filled], "question_id string, weight_class string, target_year int, "
                                 "division string, equipment string, meet_tier string, competition string")


def podium_rows(year, *placed, **more):
    return [dict(year=year, place=p, total=t, competition="National Cup", **more) for p, t in placed]


def test_places_first_then_highest_other_totals(spark, results):
    field = PO.field_table(results(*podium_rows(2020, (1, 600.0), (1, 590.0), (3, 580.0), (7, 600.0), (8, 595.0), (None, 500.0))))
    got = PO.podium_threshold(ask(spark, {}), field).first()
    assert (got["gold"], got["silver"], got["bronze"], got["data_status"]) == (600.0, 595.0, 580.0, "historical_real")


def test_single_earlier_podium_is_a_benchmark(spark, results):
    field = PO.field_table(results(*podium_rows(2017, (1, 600.0), (2, 590.0), (3, 580.0)), *podium_rows(2020, (1, 700.0))))
    got = PO.podium_threshold(ask(spark, {}, dict(question_id="none", target_year=2016)), field).collect()
    assert [(g["question_id"], g["bronze"], g["benchmark_year"], g["data_status"]) for g in got] == [
        ("q", 580.0, 2017, "historical_real_benchmark")]


def test_trend_over_three_podiums(spark, results):
    rows = [r for y, b in ((2015, 500.0), (2016, 510.0), (2017, 520.0), (2018, 530.0)) for r in podium_rows(y, (1, b + 20), (2, b + 10), (3, b))]
    got = PO.podium_threshold(ask(spark, {}), PO.field_table(results(*rows))).first()
    assert (got["bronze"], got["gold"], got["trend"], got["benchmark_year"]) == (550.0, 570.0, "rising", 2018)


def test_scope_widens_only_when_needed(spark, results):
    rows = results(dict(division="Junior", total=1.0), dict(division="Open", equipment="EQUIPPED", total=2.0), dict(division="Junior", equipment="EQUIPPED", total=3.0))
    field = PO.field_table(rows)
    asked = ask(spark, {}, dict(question_id="j", division="Junior"), dict(question_id="x", division="Master 1", equipment="EQUIPPED"),
                dict(question_id="w", division="Master 1", equipment="OTHER"), dict(question_id="later", target_year=2025))
    got = {}
    for r in PO.competitors(asked, rows, field).collect():
        got.setdefault(r["question_id"], set()).add((r["total"], r["scope_status"], r["data_status"]))
    assert got["q"] == {(2.0, PO.SCOPES[1], "historical_real_broader_benchmark")}
    assert got["j"] == {(1.0, PO.SCOPES[0], "historical_real")}
    assert {t for t, _, _ in got["x"]} == {2.0, 3.0} and {t for t, _, _ in got["w"]} == {1.0, 2.0, 3.0}
    assert got["later"] == {(2.0, PO.SCOPES[1], "historical_real_broader_benchmark")}
    assert PO.engine_columns(PO.competitors(asked, rows, field)).where("wilks_or_gl IS NOT NULL").count() == 0


def test_ranks_with_ties_and_outsiders(spark, results):
    field = results(*[dict(total=t) for t in (700.0, 650.0, 650.0, 600.0, None)])
    users = spark.createDataFrame([("a", "66", 650.0), ("b", "66", 640.0), ("c", "66", 800.0)], "who string, weight_class string, total double")
    assert {r["who"]: r["projected_rank"] for r in PO.user_ranks(users, field, ("weight_class",)).collect()} == {"a": 2, "b": 4, "c": 1}
    board = PO.leaderboard(field, ("weight_class",), "total", n=2).collect()
    assert sorted(r["projected_rank"] for r in board) == [1, 2]
    assert PO.kth_total(ask(spark, {}), field, PO.field_table(field), 3).first()["benchmark"] == 650.0
    assert PO.kth_total(ask(spark, {}), field, PO.field_table(field), 5).count() == 0


def test_gap_analysis(spark):
    df = spark.createDataFrame([(250.0, 150.0, 260.0, 650.0), (240.0, 140.0, 250.0, 650.0)], "best_squat double, best_bench double, best_deadlift double, bronze double")
    done, short = P.gap_analysis(df).collect()
    assert (done["current_total"], done["total_gap"], done["priority_lift"], done["target_squat"]) == (660.0, 0.0, "none", 250.0)
    assert (short["total_gap"], short["target_total"], short["priority_lift"]) == (20.0, 650.0, "deadlift")
    assert short["target_squat"] + short["target_bench"] + short["target_deadlift"] == pytest.approx(650, abs=0.02)
    with pytest.raises(PySparkException):
        P.gap_analysis(df.withColumn("best_squat", F.lit(-1.0))).collect()


def plain_plan(squat, bench, deadlift, target, shares):
    half = lambda v: math.floor(v / 2.5 + 0.5) * 2.5
    now = [squat, bench, deadlift]
    first = [min(half(v * shares[0]), half(v)) for v in now]
    second = [max(a, half(v * shares[1])) for a, v in zip(first, now)]
    cap = [max(b, math.floor((v * shares[2] + 1e-9) / 2.5) * 2.5) for b, v in zip(second, now)]
    total = sum(now)
    aim = math.ceil((max(target, total) - 1e-9) / 2.5) * 2.5
    rise = max(0.0, aim - total)
    wish = [v + rise * (v / total if total else 1 / 3) for v in now]
    third = [min(c, max(b, half(w))) for c, b, w in zip(cap, second, wish)]
    while aim - sum(third) >= 2.5:
        able = [i for i in range(3) if third[i] + 2.5 <= cap[i] + 1e-9]
        if not able:
            break
        third[max(able, key=lambda i: (wish[i] - third[i], now[i], -i))] += 2.5
    return first, second, third


def test_attempt_plans_match_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(float(rng.randrange(0, 300)), rng.randrange(0, 800) / 4, float(rng.randrange(0, 320)), float(rng.randrange(0, 900)),
             rng.choice(list(P.STRATEGIES))) for _ in range(80)] + [(0.0, 0.0, 0.0, 0.0, "Balanced"), (100.0, 100.0, 100.0, 321.0, "other")]
    df = spark.createDataFrame(rows, "best_squat double, best_bench double, best_deadlift double, target_total double, strategy string")
    for r in P.attempt_plan(df).collect():
        first, second, third = plain_plan(r["best_squat"], r["best_bench"], r["best_deadlift"], r["target_total"],
                                          P.STRATEGIES.get(r["strategy"], P.STRATEGIES["Balanced"]))
        for i, lift in enumerate(("squat", "bench", "deadlift")):
            assert (r[f"{lift}_attempt_1"], r[f"{lift}_attempt_2"], r[f"{lift}_attempt_3"]) == (first[i], second[i], third[i])
    status = {r["plan_status"] for r in P.plan_status(P.attempt_plan(df)).collect()}
    assert "Realistic plan below target" in status
    focus = P.focus_lift(P.attempt_plan(df.limit(5))).first()
    assert focus["focus_lift"] in ("squat", "bench", "deadlift")


def test_labels(spark):
    df = spark.createDataFrame([(0.0,), (10.04,), (60.0,), (61.0,)], "g double")
    assert [r[0] for r in df.select(P.gap_label(F.col("g"))).collect()] == ["Target reached", "+10.0 kg needed", "+60.0 kg needed", "+61.0 kg needed"]
    assert [r[0] for r in df.select(P.gap_band(F.lit(1.0), F.col("g"))).collect()] == ["reached", "close", "meaningful", "substantial"]
    goal = lambda o, p, f: df.select(P.objective_target(F.lit(o), F.lit(600.0), F.lit(p).cast("double"), F.lit(f).cast("double"))).first()[0]
    assert (goal("Podium", 641.0, None), goal("Podium", None, None), goal("Top 5", 1.0, 650.0), goal("Beat my PR", 999.0, 999.0)) == (642.5, 602.5, 650.0, 602.5)


def test_class_comparison(spark):
    bars = spark.createDataFrame([(2020, 1, 500.0), (2020, 2, 480.0), (2020, 3, 480.0)], "target_year int, class_index int, bronze double")
    who = spark.createDataFrame([("a", 60.0, 2020), ("b", 52.0, 2020)], "who string, bodyweight double, target_year int")
    got = PO.class_comparison(who, bars).collect()
    assert [(r["who"], r["class_index"], r["recommended_index"], r["difference"], r["compared"]) for r in got] == [("a", 2, 2, 0.0, 3)]
