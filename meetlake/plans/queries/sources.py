"""Sources and sinks: results are written to a fresh folder, read back by the strict readers, and compared with where they came from."""

from pyspark.sql import functions as F

from meetlake.operators import canonical as C
from meetlake.operators import identity as I
from meetlake.plans.queries.quality import _PAIRS_SQL, WITH, identity_fields
from meetlake.plans.queries.sheets import _META
from meetlake.plans.registry import query
from meetlake.plans.sheet_text import sheet_manifest
from meetlake.plans.tables import meet_results, table
from meetlake.schema import CSV_COLUMNS, RESULT_SCHEMA
from meetlake.session import fresh_folder, pinned
from meetlake.sources import readers as R
from meetlake.sources import writers as W

_ROW = ", ".join(RESULT_SCHEMA.names)


def _written(spark, d):
    folder = fresh_folder(spark, "sinks")
    return W.write_canonical(meet_results(spark, d), folder), folder


@query("stored_parquet", f"{WITH} SELECT {_ROW} FROM meet_results")
def stored_parquet(spark, d):
    """The main sink, read back where its manifest holds."""
    return W.read_written(spark, _written(spark, d)[1]).select(*RESULT_SCHEMA.names)


@query("stored_jsonl", f"{WITH} SELECT {_ROW} FROM meet_results")
def stored_jsonl(spark, d):
    """JSON lines, read back by the strict reader."""
    return R.read_canonical(spark, _written(spark, d)[0]["jsonl_path"]).select(*RESULT_SCHEMA.names)


@query("stored_csv", f"{WITH} SELECT {', '.join(CSV_COLUMNS)} FROM meet_results")
def stored_csv(spark, d):
    return W.read_written(spark, _written(spark, d)[1], "csv")


@query("line_numbers", f"{WITH} SELECT count(*) AS lines, count(*) AS places, true AS dense FROM meet_results")
def line_numbers(spark, d):
    """Numbers of the lines of the JSON files: one a line, and in every file from 1 on without a gap."""
    path = fresh_folder(spark, "lines")
    W.write_jsonl(meet_results(spark, d), path)
    per_file = R.numbered_lines(spark, path).groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("number").alias("places"), F.min("number").alias("low"),
        F.max("number").alias("high"))
    return per_file.agg(F.sum("lines").alias("lines"), F.sum("places").alias("places"),
                        F.bool_and((F.col("low") == 1) & (F.col("high") == F.col("lines"))).alias("dense"))


@query("rejected_lines", f"""{WITH}
SELECT count_if(seq % 50 <> 0) AS kept, count_if(seq % 50 = 0) AS rejected, count_if(seq % 50 = 0) AS named,
  count_if(seq % 50 = 0) AS malformed, count(*) AS records FROM meet_results""")
def rejected_lines(spark, d):
    """JSON lines of which some are cut off: the good rows, the rejects, rejects whose number leads to their line, and the check's counts."""
    path = fresh_folder(spark, "cut-lines")
    rows = meet_results(spark, d)
    line = F.to_json(F.struct(*sorted(RESULT_SCHEMA.names)), {"ignoreNullFields": "false"})
    rows.select(F.when(F.col("seq") % 50 == 0, F.regexp_replace(line, ".{5}$", "")).otherwise(line).alias("value")).write.text(path)
    good, bad = R.split_results(spark, path)
    bad, found = pinned(bad), pinned(R.checked_lines(spark, path))  # both are read twice
    again = R.numbered_lines(spark, path).withColumnRenamed("value", "line")
    named = bad.join(again, ["file", "number", "line"]).agg(F.count(F.lit(1)).alias("named")).scalar()
    return good.agg(F.count(F.lit(1)).alias("kept")).select(
        "kept", bad.agg(F.count(F.lit(1))).scalar().alias("rejected"), named.alias("named"),
        found.select("malformed").scalar().alias("malformed"), found.select("records").scalar().alias("records"))


@query("stored_manifest", """
WITH files AS (SELECT DISTINCT o_orderkey // 64 AS sheet FROM orders)
SELECT 'sheet-' || sheet AS stem, """ + _META + """ AS competition, 'Season ' || (sheet % 7 + 2015) AS year FROM files""")
def stored_manifest(spark, d):
    """A manifest file, a JSON list that names each sheet twice and has entries without a name: the last entry of a name counts."""
    number = F.floor(F.col("o_orderkey") / 64)
    files = table(spark, d, "orders").select(
        F.concat(F.lit("sheet-"), number.cast("string"), F.lit(".txt")).alias("source_file")).distinct()
    entries = sheet_manifest(files)
    old = entries.withColumns({"competition": F.lit("replaced"), "position": F.col("position") - 10**6,
                               "filename": F.concat(F.lit("up/"), F.lower("filename"))})
    nameless = entries.withColumns({"filename": F.lit(None).cast("string"), "position": F.col("position") + 10**6})
    listed = old.unionByName(entries).unionByName(nameless)
    path = fresh_folder(spark, "manifest")
    # a manifest is one list: as many entries as source files
    entry = F.struct("position", F.struct("filename", "local_path", "year", "competition").alias("e"))
    listed.agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])).alias("value")).write.text(path)
    index = C.manifest_index(R.read_manifest(spark, path))
    return index.select("stem", "competition", "year")


@query("stored_resolution", f"{WITH}, {_PAIRS_SQL} SELECT athlete_id, year, competition, classification FROM groups")
def stored_resolution(spark, d):
    """The resolution report, written and read back as the lookup of groups."""
    path = fresh_folder(spark, "resolution")
    W.write_resolution(I.resolve_groups(identity_fields(spark, d)), path)
    return R.read_resolution(spark, f"{path}/groups")


@query("stored_report", f"""{WITH}
SELECT count(*) AS total_records, count_if(equipment = 'CLASSIC') AS classic, count_if(equipment = 'EQUIPPED') AS equipped,
  count_if(equipment = 'UNKNOWN') AS unknown FROM meet_results""")
def stored_report(spark, d):
    """The quality report as a JSON file, read back."""
    path = fresh_folder(spark, "report")
    W.write_quality_report(meet_results(spark, d), path)
    return spark.read.json(path).select("dataset.total_records", "equipment.classic", "equipment.equipped", "equipment.unknown")
