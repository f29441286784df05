"""Jobs from files to files: build the canonical dataset, resolve identities, audit the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meetlake.operators import canonical as C
from meetlake.operators import identity as I
from meetlake.operators import quality as Q
from meetlake.operators.sheets import parse_sheets, sheet_sources
from meetlake.session import pinned
from meetlake.sources import readers, writers


def extract(spark: SparkSession, sheet_dir: str, manifest_path: str) -> tuple[DataFrame, DataFrame]:
    """Sources and extracted rows with their meet metadata; the rows are parsed once and pinned."""
    sheets = readers.read_sheets(spark, sheet_dir)
    index = C.manifest_index(readers.read_manifest(spark, manifest_path))
    return sheet_sources(sheets), pinned(C.with_metadata(parse_sheets(sheets), index))


def build_dataset(spark: SparkSession, sheet_dir: str, manifest_path: str, out_dir: str) -> dict[str, object]:
    """Sheets and manifest to canonical Parquet, JSON lines and CSV; returns the build counters."""
    sources, rows = extract(spark, sheet_dir, manifest_path)
    written = writers.write_canonical(C.canonical_results(rows), out_dir)
    return C.build_counters(sources, rows).first().asDict() | written


def validate(spark: SparkSession, sheet_dir: str) -> DataFrame:
    """Validation counters of a folder of sheets."""
    sheets = readers.read_sheets(spark, sheet_dir)
    return Q.validation_report(pinned(parse_sheets(sheets)), sheet_sources(sheets))


def resolve_dataset(spark: SparkSession, results_path: str, out_dir: str) -> dict[str, object]:
    """Canonical Parquet to resolved Parquet, with the resolution report beside it."""
    results = spark.read.parquet(results_path)
    writers.write_resolution(I.resolve_groups(results), f"{out_dir}/resolution")
    groups = readers.read_resolution(spark, f"{out_dir}/resolution/groups")
    writers.write_parquet(I.apply_resolution(results, groups), f"{out_dir}/resolved.parquet")
    return I.resolution_counters(spark.read.parquet(f"{out_dir}/resolved.parquet")).first().asDict()


def audit_dataset(spark: SparkSession, resolved_path: str) -> DataFrame:
    return Q.final_audit(spark.read.parquet(resolved_path))
