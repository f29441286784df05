"""Writers for canonical results, reports and contracts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from meetlake.operators.identity import resolution_summary
from meetlake.operators.quality import quality_report
from meetlake.schema import CSV_COLUMNS, PRODUCTION_FEATURES, RESULT_SCHEMA, TARGETS, require_columns
from meetlake.session import folder_files, remove_folder


def result_columns(results: DataFrame) -> DataFrame:
    """Exactly the canonical columns, in contract order."""
    return require_columns(results, RESULT_SCHEMA.names).select(*RESULT_SCHEMA.names)


def _counted(rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """The number of rows that a sink wrote, counted by the pass that writes them."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def write_parquet(results: DataFrame, path: str) -> int:
    """Main sink: partitioned by year, files balanced however uneven the years are. Returns the number of rows."""
    return _counted(result_columns(results).hint("rebalance", "year"),
                    lambda rows: rows.write.mode("overwrite").partitionBy("year").parquet(path))


def write_jsonl(results: DataFrame, path: str) -> int:
    """JSON lines with sorted keys; nulls are written. Returns the number of rows."""
    return _counted(result_columns(results).select(*sorted(RESULT_SCHEMA.names)),
                    lambda rows: rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path))


def write_csv(results: DataFrame, path: str) -> int:
    return _counted(results.select(*CSV_COLUMNS), lambda rows: rows.write.mode("overwrite").option("header", True).csv(path))


_SINKS = ("parquet", "jsonl", "csv")


def _manifest(directory: str) -> str:
    return f"{directory}/competition_results.manifest"


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files of a sink, by their path in it, with their sizes."""
    marker = path.rstrip("/").rsplit("/", 1)[-1] + "/"
    return [(name, size) for file, size, _ in folder_files(spark, path)
            if not (name := file.rsplit(marker, 1)[-1]).rsplit("/", 1)[-1].startswith(("_", "."))]


def write_canonical(results: DataFrame, directory: str) -> dict[str, object]:
    """Write Parquet once, derive JSON lines and CSV from it, and check that all counts agree.

    Each sink is written in one pass, which counts its rows. The manifest is removed first and written last: it names all
    files of the sinks with their sizes, so a folder without it or with other files is known to be torn.
    """
    spark = results.sparkSession
    paths = {kind: f"{directory}/competition_results.{kind}" for kind in _SINKS}
    remove_folder(spark, _manifest(directory))
    counts = {"parquet": write_parquet(results, paths["parquet"])}
    stored = spark.read.schema(RESULT_SCHEMA).parquet(paths["parquet"])
    counts |= {"jsonl": write_jsonl(stored, paths["jsonl"]), "csv": write_csv(stored, paths["csv"])}
    if len(set(counts.values())) != 1:
        raise RuntimeError(f"sinks disagree on the number of records: {counts}")
    files = [(kind, counts[kind], name, size) for kind in _SINKS for name, size in _listed(spark, paths[kind])]
    spark.createDataFrame(files, "sink string, records bigint, file string, bytes bigint").coalesce(1).write.json(_manifest(directory))
    return {"record_count": counts["parquet"], **{f"{k}_path": p for k, p in paths.items()}}


def read_written(spark: SparkSession, directory: str, kind: str = "parquet") -> DataFrame:
    """A sink of write_canonical, if the manifest is there and names exactly the files that are."""
    if not folder_files(spark, _manifest(directory)):
        raise ValueError(f"incomplete: no manifest in {directory}")
    rows = spark.read.schema("sink string, records bigint, file string, bytes bigint").json(_manifest(directory))
    named = {(r["file"], r["bytes"]) for r in rows.where(F.col("sink") == kind).collect()}  # as many as files
    path = f"{directory}/competition_results.{kind}"
    there = set(_listed(spark, path))
    if named != there:
        raise ValueError(f"torn: {len(named - there)} files of {path} are missing or changed, {len(there - named)} are not its own")
    reader = spark.read.schema(RESULT_SCHEMA)
    return reader.parquet(path) if kind == "parquet" else reader.json(path) if kind == "jsonl" else spark.read.schema(
        ", ".join(f"{c} {RESULT_SCHEMA[c].dataType.simpleString()}" for c in CSV_COLUMNS)).option("header", True).csv(path)


def write_quality_report(results: DataFrame, path: str) -> None:
    """The one-row nested report as a single JSON file."""
    quality_report(results).coalesce(1).write.mode("overwrite").json(path)


def write_resolution(groups: DataFrame, path: str) -> None:
    """Groups as Parquet and their counts next to them."""
    groups.write.mode("overwrite").parquet(f"{path}/groups")
    stored = groups.sparkSession.read.parquet(f"{path}/groups")
    resolution_summary(stored).withColumn("schema_version", F.lit(1)).coalesce(1).write.mode("overwrite").json(
        f"{path}/summary")


def write_contract(spark: SparkSession, path: str, features: Sequence[str] = PRODUCTION_FEATURES,
                   targets: Sequence[str] = TARGETS) -> None:
    """Feature contract as JSON, read back and compared."""
    row = spark.range(1).select(
        F.array(*[F.lit(f) for f in features]).alias("features"), F.array(*[F.lit(t) for t in targets]).alias("targets"),
        F.lit(len(features)).alias("feature_count"))
    row.coalesce(1).write.mode("overwrite").json(path)
    if read_contract(spark, path) != (tuple(features), tuple(targets)):
        raise RuntimeError("the stored feature contract differs")


def read_contract(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    stored = spark.read.json(path).select("features", "targets").first()
    return tuple(stored["features"]), tuple(stored["targets"])
