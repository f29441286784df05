import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meetlake.operators import duplicates as D
from meetlake.operators import explore as E
from meetlake.operators import identity as I
from meetlake.operators import quality as Q


def test_profile_counts_failed_and_missing(results):
    got = Q.dataset_profile(results({}, dict(squat_1=-200.0, squat_2=-1.0, best_bench=None), dict(total=None, equipment="UNKNOWN"))).first()
    assert (got["total_records"], got["squat_failed_attempts"], got["bench_missing"], got["total_missing"], got["equipment_unknown"]) == (3, 2, 1, 1, 1)


def test_empty_input(results):
    empty = results({}).where("false")
    assert Q.dataset_profile(empty).first()["total_records"] == 0
    assert Q.integrity_summary(empty).first()["total_issues"] == 0
    assert D.duplicate_report(empty).first()["duplicate_groups"] == 0
    assert Q.final_audit(empty).first()["result"] == "PASS"


def test_integrity_issues(results):
    rows = results({}, dict(bodyweight=None, total=None), dict(squat_1=-5.0), dict(total=601.0))
    kinds = Counter(r["issue_type"] for r in Q.integrity_issues(rows).collect())
    assert kinds == {"MISSING_VALUE": 2, "INVALID_VALUE": 1, "TOTAL_MISMATCH": 1}
    got = Q.integrity_summary(rows).first()
    # the four rows share athlete, meet and year, so they count once
    assert (got["records_with_issues"], got["total_issues"]) == (1, 4)
    assert Q.quality_report(rows).first()["integrity"]["total_issues"] == 4


def test_equipment_audit(results):
    rows = results({}, dict(equipment="UNKNOWN"), dict(competition="B", equipment="EQUIPPED"))
    totals = Q.equipment_totals(Q.equipment_audit(rows)).first()
    assert (totals["total_records"], totals["classic_records"], totals["competitions_with_unknown"]) == (3, 1, 1)
    assert Q.unknown_equipment(rows).count() == 1


def test_duplicates_keep_the_first_and_are_idempotent(results):
    rows = results(dict(team="A"), dict(team="B"), dict(competition="Other"), dict(year=2021), dict(team="C"))
    once = D.deduplicate(rows)
    assert {r["seq"] for r in once.collect()} == {0, 2, 3}
    assert sorted(map(str, D.deduplicate(once).collect())) == sorted(map(str, once.collect()))
    report = D.duplicate_report(rows).first()
    assert tuple(report) == (5, 3, 2, 1)
    group = D.duplicate_groups(rows).first()
    assert (group["records"], group["first_record"], group["last_record"]) == (3, 0, 4)
    assert {r["seq"] for r in D.duplicate_members(rows).collect()} == {0, 1, 4}


def test_group_verdicts_match_all_pairs(spark, results):
    rng = random.Random(11)
    rows = [dict(athlete_id=f"A{rng.randrange(12)}", year=2020, competition="M", seq=i,
                 date_of_birth=rng.choice([None, " ", "01-01-1990", "02-02-1991"]),
                 weight_class=rng.choice(["66", "66 ", "74", ""])) for i in range(45)]
    df = results(*rows)
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.athlete_id = b.athlete_id AND a.seq < b.seq")).select(
        F.col("a.athlete_id").alias("id"), F.struct("a.date_of_birth", "a.weight_class").alias("l"),
        F.struct("b.date_of_birth", "b.weight_class").alias("r")).select("id", I.pair_decision("l", "r").alias("p"))
    expected = defaultdict(Counter)
    for r in pairs.collect():
        expected[r["id"]][r["p"]["reason"]] += 1
    got = {r["athlete_id"]: r for r in I.resolve_groups(df).collect()}
    assert set(got) == set(expected)
    for who, reasons in expected.items():
        g = got[who]
        for reason in ("SAME_DATE_OF_BIRTH", "DIFFERENT_DATE_OF_BIRTH", "DIFFERENT_WEIGHT_CLASS_WITHOUT_DOB", "INSUFFICIENT_IDENTITY_METADATA"):
            assert g[reason.lower()] == reasons[reason]
        split = reasons["DIFFERENT_DATE_OF_BIRTH"] + reasons["DIFFERENT_WEIGHT_CLASS_WITHOUT_DOB"]
        verdict = "SAME" if set(reasons) == {"SAME_DATE_OF_BIRTH"} else "SPLIT" if split else "UNRESOLVED"
        assert g["classification"] == verdict


def test_applied_identity(results):
    rows = results(
        dict(athlete_id="S", date_of_birth="01-01-1990"), dict(athlete_id="S", date_of_birth="01-01-1990"),
        dict(athlete_id="D", date_of_birth="01-01-1990"), dict(athlete_id="D", date_of_birth="02-01-1990"),
        dict(athlete_id="U", date_of_birth="01-01-1990"), dict(athlete_id="U"),
        dict(athlete_id="N", date_of_birth="01-01-1990"), dict(athlete_id="C"))
    got = {r["seq"]: (r["identity_confidence"], r["resolved_athlete_id"]) for r in I.apply_resolution(rows, I.resolve_groups(rows)).collect()}
    assert [got[i][0] for i in range(8)] == ["RESOLVED_SAME"] * 2 + ["RESOLVED_SPLIT"] * 2 + ["UNRESOLVED"] * 2 + ["HIGH", "CANDIDATE"]
    assert got[0][1] == got[1][1] == got[6][1] and got[2][1] != got[3][1]
    assert got[4][1] is None and got[7][1] == "C"
    older = {r["seq"]: r["identity_confidence"] for r in I.assign_by_birth_date(rows).collect()}
    assert older[4] == "HIGH" and older[5] == "CANDIDATE"


def test_collisions(results):
    rows = results({}, {}, dict(weight_class="74"), dict(athlete_id="B"), dict(athlete_id="B", year=2021), dict(athlete_id="C"))
    assert {(r["athlete_id"], r["contexts"]) for r in I.identity_collisions(rows).collect()} == {("A1", 2), ("B", 2)}
    meet = I.same_meet_collisions(rows).collect()
    assert [(r["athlete_id"], r["records"], r["contexts"]) for r in meet] == [("A1", 3, 2)]
    assert tuple(I.collision_statistics(rows).first()) == (3, 2, 1)


def test_final_audit_fails_on_mismatch_and_duplicates(results):
    fine = dict(resolved_athlete_id="R")
    assert Q.final_audit(results(fine)).first()["result"] == "PASS"
    bad = Q.final_audit(results(fine, fine, dict(fine, competition="B", total=600.02), dict(squat_1=0.0, competition="C"))).first()
    assert (bad["result"], bad["duplicate_groups"], bad["total_mismatches"], bad["zero_attempts"], bad["missing_resolved_athlete_id"]) == ("FAIL", 1, 1, 1, 1)


def test_validation_of_repeated_rows(spark):
    from meetlake.operators.sheets import parse_sheets, sheet_sources
    from tests.test_sheets import H3, LIFTS
    line = f"1 A NAME 13-08-1991 T N 62 58.80 0.14 {LIFTS}\n"
    bad = f"2 B NAME 13-08-1991 T N 62 58.80 0.14 {LIFTS.replace('552.5', '550')}\n"
    df = spark.createDataFrame([("a", H3 + "Open - 59kg\n" + line + bad + line), ("b", "no sheet"), ("c", H3 + line + "Open - 59kg")], "source_file string, text string")
    rows, sources = parse_sheets(df), sheet_sources(df)
    got = Q.validation_report(rows, sources).first()
    assert (got["total_sources"], got["failed_sources"], got["total_rows"], got["duplicate_rows"], got["total_mismatches"], got["missing_weight_class"]) == (3, 1, 4, 1, 1, 1)
    kinds = Counter(r["issue_type"] for r in Q.validation_issues(rows, sources).collect())
    assert kinds == {"DUPLICATE_ROW": 1, "TOTAL_MISMATCH": 1, "SOURCE_ERROR": 1, "MISSING_WEIGHT_CLASS": 1, "MISSING_DIVISION": 1}


def test_shares_and_profiles(results):
    rows = results({}, dict(team=None), dict(division="Junior"))
    shares = {r["value"]: (r["records"], r["percent"]) for r in E.frequency_share(rows, "division").collect()}
    assert shares == {"Open": (2, 66.67), "Junior": (1, 33.33)}
    missing = {r["field"]: r["missing"] for r in E.column_profile(rows).collect()}
    assert missing["team"] == 3 and missing["total"] == 0
    assert E.career_summary(rows).first()["records"] == 3
    assert {r["field"] for r in E.describe(rows).collect()} == set(E.NUMERIC)
    assert pytest.approx(0.0) == E.correlation(rows.withColumn("total", F.col("seq") * 1.0).withColumn(
        "bodyweight", (F.col("seq") - 1) * (F.col("seq") - 1) * 1.0)).where("left = 'bodyweight' AND right = 'total'").first()["correlation"]
