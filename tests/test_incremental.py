"""A second build parses what has changed and ends where a full build does."""

import pytest

from meetlake.operators import canonical as C
from meetlake.plans import build, incremental
from meetlake.session import remove_folder
from tests.test_files_models import folder  # noqa: F401
from tests.test_sheets import H1, LIFTS

_COUNTERS = ("source_count", "parsed_source_count", "incomplete_count", "review_count", "normalized_count", "record_count")


def rows_of(spark, path):
    return sorted(map(str, spark.read.parquet(path).select("athlete_name", "competition", "year", "total", "place").collect()))


def test_changed_new_and_dropped_sheets(spark, folder):  # noqa: F811
    sheets, manifest, kept = (str(folder / n) for n in ("sheets", "manifest.json", "kept"))

    def both(turn):
        again = incremental.build_again(spark, sheets, manifest, kept, str(folder / f"again{turn}"))
        full = build.build_dataset(spark, sheets, manifest, str(folder / f"full{turn}"))
        assert {c: again[c] for c in _COUNTERS} == {c: full[c] for c in _COUNTERS}
        assert rows_of(spark, again["parquet_path"]) == rows_of(spark, full["parquet_path"])
        return {c: again[c] for c in ("run", "parsed", "kept", "dropped")}

    assert both(0) == {"run": 1, "parsed": 3, "kept": 0, "dropped": 0}
    assert both(1) == {"run": 2, "parsed": 0, "kept": 3, "dropped": 0}
    (folder / "sheets" / "One.txt").write_text(H1 + f"59kg - Open\n1 OTHER NAME 13-08-1991 PUD 62 58.80 {LIFTS}\n2 MORE NAMES 13-08-1991 PUD 62 58.80 {LIFTS}\n")
    (folder / "sheets" / "bad.txt").unlink()
    (folder / "sheets" / "else.txt").write_text("nothing of the kind")
    assert both(2) == {"run": 3, "parsed": 2, "kept": 1, "dropped": 2}
    # a run that stopped before its state leaves the one before in force
    remove_folder(spark, f"{kept}/state/run=3")
    assert incremental.last_run(spark, kept) == 2
    assert sorted(r["source_file"] for r in incremental.current_sources(spark, kept).collect()) == ["One.txt", "bad.txt", "two.txt"]
    assert both(3) == {"run": 3, "parsed": 2, "kept": 1, "dropped": 2}


def test_names_are_unique_and_empty_folders_build(spark, tmp_path):
    twice = spark.createDataFrame([("a.txt", "x"), ("a.txt", "y")], "source_file string, text string")
    with pytest.raises(ValueError, match="share a name"):
        incremental.refresh(twice, str(tmp_path / "twice"))
    none = incremental.refresh(twice.limit(0), str(tmp_path / "none"))
    assert none == {"run": 1, "parsed": 0, "kept": 0, "dropped": 0}
    assert C.build_counters(incremental.current_sources(spark, str(tmp_path / "none")),
                            incremental.current_rows(spark, str(tmp_path / "none"))).first()["source_count"] == 0
