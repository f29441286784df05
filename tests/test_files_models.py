import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meetlake.operators import canonical as C
from meetlake.operators import metrics as M
from meetlake.plans import build, models as ML
from meetlake.schema import CSV_COLUMNS, HISTORY_FEATURES, PRODUCTION_FEATURES, TARGETS, forbid_columns
from meetlake.sources import readers as R, writers as W
from tests.test_sheets import H1, H3, LIFTS


@pytest.fixture()
def folder(tmp_path):
    sheets = tmp_path / "sheets"
    sheets.mkdir()
    (sheets / "One.txt").write_text(H1 + f"59kg - Open\n1 A NAME 13-08-1991 PUD 62 58.80 {LIFTS}\n3 unreadable line\n", encoding="utf-8")
    (sheets / "two.txt").write_text(H3 + f"Open - 66kg\n1 B NAME 13-08-1991 T N 62 58.80 0.14 {LIFTS}\n- C NAME 13-08-1991 T N 6 58.80 0.14 100 110\n", encoding="utf-8")
    (sheets / "bad.txt").write_bytes(b"Place \xff\xfe Name")
    entries = [{"filename": "up/ONE.pdf", "year": "2018", "competition": "Old Cup"},
               {"filename": "ONE.PDF", "year": "Season 2019", "competition": " Classic Cup "},
               {"filename": "else.pdf", "local_path": "x\\two.bin", "year": "2020", "competition": "Equipped Cup"},
               {"filename": "bad.pdf", "year": "2020", "competition": "Cup"}, {"year": "2000", "competition": "no file"}]
    (tmp_path / "manifest.json").write_text(json.dumps(entries), encoding="utf-8")
    return tmp_path


def test_build_from_files(spark, folder):
    out = str(folder / "out")
    got = build.build_dataset(spark, str(folder / "sheets"), str(folder / "manifest.json"), out)
    assert {k: got[k] for k in ("source_count", "parsed_source_count", "incomplete_count", "review_count", "normalized_count", "record_count")} == {
        "source_count": 3, "parsed_source_count": 2, "incomplete_count": 1, "review_count": 1, "normalized_count": 2, "record_count": 2}
    rows = {r["athlete_name"]: r for r in R.read_canonical(spark, got["jsonl_path"]).collect()}
    assert (rows["A NAME"]["competition"], rows["A NAME"]["year"], rows["A NAME"]["equipment"]) == ("Classic Cup", 2019, "CLASSIC")
    assert (rows["B NAME"]["competition"], rows["B NAME"]["equipment"]) == ("Equipped Cup", "EQUIPPED")
    assert spark.read.option("header", True).csv(got["csv_path"]).columns == list(CSV_COLUMNS)
    assert build.validate(spark, str(folder / "sheets")).first()["failed_sources"] == 1
    resolved = build.resolve_dataset(spark, got["parquet_path"], out)
    assert (resolved["total"], resolved["high"], resolved["candidate"]) == (2, 1, 1)
    assert build.audit_dataset(spark, out + "/resolved.parquet").first()["result"] == "PASS"
    tolerant = R.read_sheets(spark, str(folder / "sheets"), tolerant=True).where("source_file = 'bad.txt'").first()
    assert "�" in tolerant["text"]
    assert R.read_files(spark, str(folder / "sheets"), "*.txt").count() == 3


def test_unknown_source_fails_only_in_strict_mode(spark, folder):
    (folder / "manifest.json").write_text("[]", encoding="utf-8")
    sources, rows = build.extract(spark, str(folder / "sheets"), str(folder / "manifest.json"))
    with pytest.raises(PySparkException):
        C.canonical_results(rows).collect()
    assert C.canonical_results(rows, strict=False).count() == 0
    assert {r["reason"] for r in C.rejected_rows(rows).collect()} == {"no manifest entry or meet name"}
    index = C.manifest_index(R.read_manifest(spark, str(folder / "manifest.json")))
    assert C.unknown_sources(sources, index).count() == 3


def test_result_files(spark, results, tmp_path):
    rows = results(dict(resolved_athlete_id="R"), dict(total=None))
    W.write_jsonl(rows, str(tmp_path / "j"))
    line = json.loads("".join(p.read_text() for p in sorted((tmp_path / "j").glob("*.json"))).splitlines()[0])
    assert list(line) == sorted(line) and "team" in line and line["team"] is None
    (tmp_path / "broken.jsonl").write_text(json.dumps(line) + "\n\n{not json\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        R.read_results(spark, str(tmp_path / "broken.jsonl")).collect()
    good, bad = R.split_results(spark, str(tmp_path / "broken.jsonl"))
    assert good.count() == 1 and [(r["line"], r["number"]) for r in bad.collect()] == [("{not json", 3)]
    (tmp_path / "words.jsonl").write_text(json.dumps(line) + "\n" + json.dumps({**line, "bodyweight": "sixty"}) + "\n")
    good, bad = R.split_results(spark, str(tmp_path / "words.jsonl"))
    assert good.count() == 1 and "sixty" in bad.first()["line"]
    assert good.columns == R.read_results(spark, str(tmp_path / "words.jsonl")).columns
    with pytest.raises(ValueError, match="malformed line 3 of .*broken.jsonl: {not json"):
        R.read_canonical(spark, str(tmp_path / "broken.jsonl"))
    (tmp_path / "blank.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="no records"):
        R.read_canonical(spark, str(tmp_path / "blank.jsonl"))
    (tmp_path / "short.jsonl").write_text('{"athlete_id": "a"}\n')
    with pytest.raises(ValueError, match="missing columns"):
        R.read_canonical(spark, str(tmp_path / "short.jsonl"))
    W.write_quality_report(rows, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).first()["dataset"]["total_records"] == 2
    W.write_contract(spark, str(tmp_path / "c"))
    assert W.read_contract(spark, str(tmp_path / "c"))[0] == PRODUCTION_FEATURES
    (tmp_path / "report.json").write_text(json.dumps({"groups": [
        {"athlete_id": "a", "year": 2020, "competition": "M", "classification": c} for c in ("SAME", "SPLIT")]}))
    assert R.read_resolution(spark, str(tmp_path / "report.json")).first()["classification"] == "SPLIT"


def test_lines_are_numbered_over_many_splits(spark, tmp_path, request):
    """Files of several splits, with blank lines, long lines and no line feed at the end."""
    rng = random.Random(2)
    files = {}
    for name, n in (("a.txt", 400), ("b.txt", 1), ("c.txt", 77)):
        files[name] = ["" if rng.random() < 0.1 else f"{name}{k}" + "x" * rng.choice([0, 5, 300]) for k in range(n)] + ["end"]
        (tmp_path / name).write_text("\n".join(files[name]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.files.maxPartitionBytes"))
    got = {(r["file"].rsplit("/", 1)[-1], r["number"]): r["value"] for r in R.numbered_lines(spark, str(tmp_path)).collect()}
    assert got == {(f, n): v for f, lines in files.items() for n, v in enumerate(lines, 1)}
    assert R._lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 10


def test_the_first_bad_line_of_a_large_file_is_named(spark, results, tmp_path, request):
    rows = results(*[dict(athlete_id=f"a{k}", total=float(k)) for k in range(300)])
    W.write_jsonl(rows.coalesce(1), str(tmp_path / "j"))
    lines = next((tmp_path / "j").glob("*.json")).read_text().splitlines()
    lines[210], lines[250] = lines[210][:-3], "[]"
    (tmp_path / "large.jsonl").write_text("\n\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.files.maxPartitionBytes"))
    with pytest.raises(ValueError, match="malformed line 421 of"):
        R.read_canonical(spark, str(tmp_path / "large.jsonl"))
    found = R.checked_lines(spark, str(tmp_path / "large.jsonl")).first()
    assert (found["records"], found["malformed"], found["number"], found["absent"]) == (300, 2, 421, [])


def test_torn_folders_are_refused(spark, results, tmp_path):
    out = str(tmp_path / "out")
    rows = results(*[dict(year=2018 + k % 3, total=float(k)) for k in range(30)])
    assert W.write_canonical(rows, out)["record_count"] == 30
    for kind in ("parquet", "jsonl", "csv"):
        assert W.read_written(spark, out, kind).agg(F.sum("total"), F.count("*")).first() == (435.0, 30)
    part = next((tmp_path / "out" / "competition_results.jsonl").glob("*.json"))
    text = part.read_text()
    part.write_text(text[:-10])
    with pytest.raises(ValueError, match="torn"):
        W.read_written(spark, out, "jsonl")
    part.write_text(text)
    next((tmp_path / "out" / "competition_results.parquet").rglob("*.parquet")).unlink()
    with pytest.raises(ValueError, match="torn"):
        W.read_written(spark, out)
    W.remove_folder(spark, W._manifest(out))
    with pytest.raises(ValueError, match="incomplete"):
        W.read_written(spark, out, "csv")
    assert W.write_canonical(rows.limit(0), out)["record_count"] == 0 and W.read_written(spark, out, "jsonl").count() == 0


def history(athletes=40):
    rows = []
    for a in range(athletes):
        for y in range(2015, 2021):
            s = 150.0 + a + 2 * (y - 2015)
            rows.append(dict(athlete_id=f"A{a}", resolved_athlete_id=f"A{a}", year=y, best_squat=s, best_bench=s / 2, best_deadlift=s + 20,
                             total=2.5 * s + 20, division="Open" if a % 2 else "Junior", bodyweight=60.0 + a % 9))
    return rows


def test_models_end_to_end(spark, results, tmp_path):
    from meetlake.operators.temporal import supervised_dataset
    table = results(*history())
    rows = M.with_split(supervised_dataset(table), 2018, 2019).cache()
    assert M.shared_years(rows).count() == 0
    prep, fitted, prepared = ML.session_models(spark, rows.withColumn("seq", F.monotonically_increasing_id()), 1000, "seq",
                                               ("Ridge", "Random Forest"))
    metrics = M.error_metrics(ML.long_predictions(prepared.where("split = 'validation'"), fitted))
    assert metrics.count() == 8
    chosen = {r["target"]: r["model"] for r in M.best_models(metrics).collect()}
    assert set(chosen) == set(TARGETS)
    best = metrics.groupBy().agg(F.min("mae")).first()[0]
    assert best < 15
    models = ML.production_models(prep, fitted, chosen)
    asked = spark.createDataFrame([("r1", "A1", 2021, "Open", "66", "CLASSIC"), ("r2", "A2", 2016, "Brand new", None, "CLASSIC"),
                                   ("r3", "nobody", 2021, "Open", "66", "CLASSIC")],
                                  "request_id string, resolved_athlete_id string, target_year int, division string, weight_class string, equipment string")
    feats = ML.request_features(asked, table)
    assert feats.count() == 2 and set(PRODUCTION_FEATURES) <= set(feats.columns)
    one = ML.predict(feats, models)
    ML.save_models(models, str(tmp_path / "m"))
    again = ML.predict(feats, ML.load_models(str(tmp_path / "m")))
    same = M.prediction_difference(one, again, ("request_id",), [f"predicted_{t}" for t in TARGETS]).first()
    assert same["rows"] == 2 and same["equal"] is True
    report = ML.prediction_report(one, ML.long_predictions(prepared.where("split = 'test'"), {(m, t): fitted[(m, t)] for t, m in chosen.items()}), ("request_id",))
    assert report.count() == 8 and report.where("historical_p90_error_kg IS NULL").count() == 0


def test_request_rows(spark, results):
    table = results(*[dict(resolved_athlete_id="P", year=y, total=t) for y, t in ((2017, 500.0), (2018, 520.0), (2019, 560.0))],
                    dict(resolved_athlete_id="Q", year=2019, total=400.0))
    asked = spark.createDataFrame([("p", "P", 2020), ("q", "Q", 2021), ("early", "P", 2018)], "request_id string, resolved_athlete_id string, target_year int") \
        .selectExpr("*", "'Open' AS division", "'66' AS weight_class", "'CLASSIC' AS equipment")
    lagged = {r["request_id"]: r for r in ML.request_features(asked, table).collect()}
    assert (lagged["p"]["previous_total"], lagged["p"]["previous_total_change"], lagged["p"]["years_since_previous"], lagged["p"]["year"]) == (520.0, 20.0, 1, 2020)
    assert (lagged["q"]["previous_total"], lagged["q"]["historical_std_total"], lagged["q"]["years_since_previous"], lagged["q"]["previous_year_count"]) == (400.0, 0.0, 2, 1)
    assert lagged["early"]["previous_total"] == 500.0
    through = {r["request_id"]: r for r in ML.request_features(asked, table, "as_of_target").collect()}
    assert (through["p"]["previous_total"], through["p"]["previous_total_change"], through["p"]["historical_max_total"]) == (560.0, 40.0, 560.0)
    with pytest.raises(ValueError):
        ML.request_features(asked, table, "other")
    assert ML.history_violations(asked, table).count() == 2  # the early request: 2018 and 2019
    projected = ML.field_projection(table, lagged_frame(spark), ("resolved_athlete_id",))
    assert {(r["resolved_athlete_id"], r["projection_source"]) for r in projected.collect()} == {
        ("P", "AI prediction if competing"), ("Q", "Historical benchmark")}
    assert ML.projection_failures(projected).first()["failures"] == 1


def lagged_frame(spark):
    return spark.createDataFrame([("P", 600.0)], "resolved_athlete_id string, predicted_total double")


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("m", "t", 1.0, 2.0), ("m", "t", 3.0, 3.0), ("m", "t", 5.0, 2.0), ("n", "t", 1.0, None)],
                               "model string, target string, actual double, predicted double")
    got = M.error_metrics(df).first()
    assert (got["n"], got["mae"], got["median_absolute_error"]) == (3, pytest.approx(4 / 3), 1.0)
    assert got["r2"] == pytest.approx(1 - 10 / 8) and got["rmse"] == pytest.approx((10 / 3) ** 0.5)
    assert M.bias(df).first()["direction"] == "UNDERPREDICTION"


def test_guards_and_grid():
    with pytest.raises(ValueError, match="not allowed"):
        forbid_columns((*HISTORY_FEATURES, "total"), TARGETS)
    grid = ML.sampled_grid({"depth": (2, 3), "min_rows": (1, 2)}, 20)
    assert len(grid) == 4 and len(ML.sampled_grid(ML.TUNING["Gradient Boosting"], 20)) == 20


def test_requests_with_their_own_history(spark, results):
    rows = results(*[dict(athlete_id="x", year=y, total=t) for y, t in ((2017, 500.0), (2018, 520.0))], dict(athlete_id="x", year=2021))
    history = rows.withColumn("request_id", F.when(F.col("year") == 2021, "late").otherwise("fine"))
    asked = spark.createDataFrame([("fine", 2020), ("late", 2021), ("none", 2020), ("fine2", None)], "request_id string, target_year int") \
        .selectExpr("*", "'Open' AS division", "'66' AS weight_class", "'CLASSIC' AS equipment")

    class Total:
        def transform(self, df):
            return df.withColumn("predicted", F.col("previous_total") + 1)

    got = {r["request_id"]: r for r in ML.answered(asked, history, {"total": Total()}).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "fine": "ACCEPTED", "late": "HISTORY_REACHES_TARGET", "none": "NO_HISTORY", "fine2": "REJECTED"}
    # as in the feature rows of single requests: the latest year's features describe the time before it
    assert got["fine"]["predicted_total"] == 501.0 and all(got[k]["predicted_total"] is None for k in ("late", "none", "fine2"))


def test_kept_models_depend_on_the_files(spark, tmp_path):
    import os
    from meetlake.session import file_stamp
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    first = file_stamp(spark, str(tmp_path))
    assert first == file_stamp(spark, str(tmp_path))
    part = next(p for p in (tmp_path / "t.parquet").iterdir() if p.suffix == ".parquet")
    os.utime(part, (1, 1))
    assert file_stamp(spark, str(tmp_path)) != first


def test_rejects_are_found_once(spark, results, monkeypatch):
    """Lines are parsed for the good rows, the rejects and the check, and no second time for a reader of one of them."""
    from meetlake.plans.queries import sources as SO
    rows = results(*[dict(athlete_id=f"A{n}") for n in range(120)])
    monkeypatch.setattr(SO, "meet_results", lambda spark, d: rows)
    found = SO.rejected_lines(spark, "")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") + found._jdf.queryExecution(
        ).optimizedPlan().toString().count("jsontostructs") <= 2
    assert tuple(found.first()) == (117, 3, 3, 3, 120)
