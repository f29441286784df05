"""Readers for sheets, manifests, canonical results, exports and resolution reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meetlake.operators.service import application_table
from meetlake.schema import MANIFEST_SCHEMA, RESULT_SCHEMA, require_columns

_BAD = "_corrupt_record"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries of a JSON list with their position; anything but a list of objects fails."""
    entries = (spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(MANIFEST_SCHEMA).json(path))
    return entries.withColumn("position", F.monotonically_increasing_id())


def read_sheets(spark: SparkSession, directory: str, tolerant: bool = False) -> DataFrame:
    """One row per .txt sheet: source_file, text.

    A sheet that is not valid UTF-8 has a null text, so it turns up as an ERROR source; in tolerant mode
    its bad bytes are replaced instead.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(directory)
    text = F.col("content").cast("string")
    fixed = F.make_valid_utf8(text) if tolerant else F.try_validate_utf8(text)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), fixed.alias("text"))


def read_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """Raw bytes of files with their name, for integrity facts."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Canonical JSON lines; blank lines are skipped, and a malformed line fails the job."""
    return spark.read.option("mode", "FAILFAST").schema(RESULT_SCHEMA).json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file, the byte at which their split begins, and an ascending id within a task."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"))


def _offsets(splits: DataFrame) -> DataFrame:
    """splits (file, split, first, n, ...) with ``before``: the lines of the file before the split. One row a split."""
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, value): every line with its number in its file from 1, blank lines counted.

    Splits are read where they lie; a line's number is its place in the split and the lines of the splits before, which are
    counted in a pass of their own and sent as one row a split.
    """
    lines = _lines(spark, path)
    splits = _offsets(lines.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    return lines.join(splits, ["file", "split"]).select(
        "file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("number"), "value")


def _parsed(lines: DataFrame) -> DataFrame:
    schema = T.StructType([*RESULT_SCHEMA.fields, T.StructField(_BAD, T.StringType(), True)])
    return lines.withColumn("row", F.when(F.trim("value") != "", F.from_json("value", schema, {"columnNameOfCorruptRecord": _BAD})))


def split_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The good rows of canonical JSON lines, and the lines that read_results would fail on: (rows, rejects).

    A reject has its file, its line's number in the file (from 1) and the line itself: between the two tables no line but
    blank ones is lost.
    """
    parsed = _parsed(numbered_lines(spark, path)).where("row IS NOT NULL")
    rows = _parsed(spark.read.text(path)).where(F.col("row").isNotNull() & F.col(f"row.{_BAD}").isNull()).select(
        *[f"row.{n}" for n in RESULT_SCHEMA.names])
    rejects = parsed.where(F.col(f"row.{_BAD}").isNotNull()).select("file", "number", F.col("value").alias("line"))
    return rows, rejects


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines the reader fails on, with their file and number."""
    return split_results(spark, path)[1]


def checked_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row about canonical JSON lines: records, malformed (lines), where the first one is (file, number, line), and absent,
    the required columns that no line has.

    The lines are read once: each split reports its lines, its records, its first malformed line and the columns it has.
    """
    required = F.array(*[F.lit(n) for n in RESULT_SCHEMA.names])
    parsed = _parsed(_lines(spark, path))
    known, bad = F.col("row").isNotNull(), F.col(f"row.{_BAD}").isNotNull()
    keys = F.json_object_keys("value")
    splits = _offsets(parsed.groupBy("file", "split").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(known).alias("records"),
        F.count_if(known & bad).alias("malformed"), F.min(F.when(known & bad, F.struct("id", "value"))).alias("bad"),
        *[F.coalesce(F.bool_or(F.array_contains(keys, c)), F.lit(False)).alias(f"has_{c}") for c in RESULT_SCHEMA.names]))
    place = F.struct("file", (F.col("bad.id") - F.col("first") + F.col("before") + 1).alias("number"),
                     F.substring("bad.value", 1, 200).alias("line"))
    present = F.array(*[F.bool_or(f"has_{c}") for c in RESULT_SCHEMA.names])
    whole = splits.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("malformed"), F.lit(0)).alias(
        "malformed"), F.min(F.when(F.col("bad").isNotNull(), place)).alias("first"), present.alias("present"))
    return whole.select("records", "malformed", "first.file", "first.number", "first.line", F.filter(
        F.transform(required, lambda c, i: F.when(~F.coalesce(F.get("present", i), F.lit(False)), c)),
        lambda c: c.isNotNull()).alias("absent"))


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Strict canonical table: malformed lines, missing columns and an empty file all fail; the first bad line is named."""
    found = checked_lines(spark, path).first()
    if found["malformed"]:
        raise ValueError(f"malformed line {found['number']} of {found['file']}: {found['line']}")
    if not found["records"]:
        raise ValueError(f"no records in {path}")
    if found["absent"]:
        raise ValueError("missing columns: " + ", ".join(sorted(found["absent"])))
    return read_results(spark, path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Tabular export (CSV with header) as the checked, trimmed and coerced application table."""
    return application_table(spark.read.option("header", True).csv(path))


def read_resolution(spark: SparkSession, path: str) -> DataFrame:
    """Groups of a resolution report: athlete_id, year, competition, classification.

    Takes the parquet folder written by write_resolution, or a single JSON report with a ``groups`` list.
    """
    if path.endswith(".json"):
        report = spark.read.option("multiLine", True).json(path)
        groups = require_columns(report, ("groups",)).select(F.posexplode("groups").alias("at", "g")).select("at", "g.*")
    else:
        groups = spark.read.parquet(path).withColumn("at", F.lit(0))
    return groups.groupBy("athlete_id", F.col("year").cast("int").alias("year"), "competition").agg(
        F.max_by("classification", "at").alias("classification"))
