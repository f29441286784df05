"""Building again over sheets of which few have changed: only new and changed sheets are parsed.

A folder keeps parsed rows, appended run by run, and a state for each run: one row a sheet with the hash of its text and the run
that parsed it. The rows of a sheet are those of its run in the state; rows of earlier runs are passed over by the same join, so
nothing that is stored is rewritten. A state is written last: a run that stops half-way leaves the one before in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.operators import canonical as C
from meetlake.operators.sheets import parse_sheets, sheet_sources
from meetlake.session import folder_files
from meetlake.sources import readers, writers

_STATE = "source_file string, sha256 string, run int, detected_format string, status string, error string"


def last_run(spark: SparkSession, folder: str) -> int:
    """The number of the last complete run, 0 before the first."""
    done = [file for file, _, _ in folder_files(spark, f"{folder}/state") if file.endswith("/_SUCCESS")]
    return max((int(file.rsplit("/", 2)[-2].removeprefix("run=")) for file in done), default=0)


def state(spark: SparkSession, folder: str, run: int | None = None) -> DataFrame:
    """What a run left (the last one unless given): a row a sheet, with the run whose rows are its rows."""
    run = last_run(spark, folder) if run is None else run
    return spark.createDataFrame([], _STATE) if not run else spark.read.schema(_STATE).parquet(f"{folder}/state/run={run}")


def refresh(sheets: DataFrame, folder: str) -> dict[str, int]:
    """Bring the folder up to date with sheets (source_file, text); returns how many were parsed, kept and dropped.

    Sheets are compared by the hash of their text; null (an unreadable sheet) is a text like others. Two sheets of one name fail.
    """
    spark = sheets.sparkSession
    twice = sheets.groupBy("source_file").count().where("count > 1").first()
    if twice:
        raise ValueError(f"{twice['count']} sheets share a name: {twice['source_file']}")
    run = last_run(spark, folder) + 1
    before = state(spark, folder)
    hashed = sheets.select("source_file", "text", F.coalesce(F.sha2("text", 256), F.lit("unreadable")).alias("sha256"))
    known = before.select("source_file", "sha256")
    changed = hashed.join(known, ["source_file", "sha256"], "left_anti")
    parsed = f"{folder}/rows/run={run}"
    parse_sheets(changed.select("source_file", "text")).write.mode("overwrite").parquet(parsed)
    fresh = sheet_sources(changed.select("source_file", "text")).join(changed.select("source_file", "sha256"), "source_file").select(
        "source_file", "sha256", F.lit(run).alias("run"), "detected_format", "status", "error")
    kept = before.join(hashed.select("source_file", "sha256"), ["source_file", "sha256"], "left_semi").select(*fresh.columns)
    now = f"{folder}/state/run={run}"
    fresh.unionByName(kept).write.mode("overwrite").parquet(now)
    found = state(spark, folder, run).agg(F.count(F.lit(1)).alias("sheets"), F.count_if(F.col("run") == run).alias("parsed")).first()
    return {"run": run, "parsed": found["parsed"], "kept": found["sheets"] - found["parsed"],
            "dropped": before.count() - (found["sheets"] - found["parsed"])}


def current_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The parsed rows of all sheets as they are now."""
    of = state(spark, folder).select("source_file", "run")
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return rows.join(of, ["source_file", "run"]).drop("run")


def current_sources(spark: SparkSession, folder: str) -> DataFrame:
    return state(spark, folder).select("source_file", "detected_format", "status", "error")


def build_again(spark: SparkSession, sheet_dir: str, manifest_path: str, folder: str, out_dir: str) -> dict[str, object]:
    """build.build_dataset over a folder of parsed rows: the same sinks and counters, and what was parsed for them."""
    done = refresh(readers.read_sheets(spark, sheet_dir), folder)
    index = C.manifest_index(readers.read_manifest(spark, manifest_path))
    rows = current_rows(spark, folder)
    written = writers.write_canonical(C.canonical_results(C.with_metadata(rows, index)), out_dir)
    return C.build_counters(current_sources(spark, folder), rows).first().asDict() | written | done
