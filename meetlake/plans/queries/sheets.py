"""Round trips: results are written as sheets of all layouts, parsed back and normalised."""

from pyspark.sql import functions as F

from meetlake.operators import canonical as C
from meetlake.operators import quality as Q
from meetlake.operators import sheets as SH
from meetlake.plans import incremental as IN
from meetlake.plans.queries.quality import WITH
from meetlake.plans.registry import query
from meetlake.plans.sheet_text import ODD, odd_sheets, sheet_manifest, sheet_texts
from meetlake.plans.tables import meet_results, table, texts
from meetlake.schema import LIFT_BLOCK, LIFTS, MEASURES
from meetlake.session import fresh_folder, pinned

# what each layout keeps: rows without a birth date are unreadable, the later layouts show no identity fields
PARSED_SQL = f"""
placed AS (
  SELECT *, seq // 64 AS sheet, seq // 64 % 4 AS layout FROM meet_results),
shown AS (SELECT * FROM placed WHERE NOT (layout = 0 AND weight_class = '120+')),
parsed AS (
  SELECT 'sheet-' || sheet || '.txt' AS source_file, sheet, layout, 'FORMAT' || (layout + 1) AS detected_format,
    CASE WHEN layout = 0 THEN 'PARSED' WHEN total IS NULL THEN 'INCOMPLETE' ELSE 'PARSED' END AS status,
    weight_class, division, CASE WHEN layout = 2 THEN 'Men' END AS gender, place, athlete_name,
    CASE WHEN layout < 2 THEN date_of_birth END AS date_of_birth, CASE WHEN layout < 2 THEN team END AS team,
    CASE WHEN layout < 2 THEN lot END AS lot, {", ".join(MEASURES)}, seq
  FROM shown WHERE date_of_birth IS NOT NULL)"""
_FIELDS = ("source_file", "status", "weight_class", "division", "gender", "place", "athlete_name", "date_of_birth",
           "team", "lot", *MEASURES)


def sheets(spark, d):
    return sheet_texts(meet_results(spark, d))


def stored_sheets(spark, d, text="text"):
    """The sheets for queries that read them more than once, as a folder of files would be, with their layout judged once.

    They are dealt evenly: reading a sheet takes much longer than moving it, and uneven files would keep some tasks waiting.
    """
    even = sheets(spark, d).select("source_file", F.expr(text).alias("text")).repartition(4 * spark.sparkContext.defaultParallelism)
    return pinned(SH.detect_sheets(even))


def _layout(number):
    sql = f"""{WITH}, {PARSED_SQL} SELECT {", ".join(_FIELDS)} FROM parsed WHERE layout = {number - 1}"""

    @query(f"sheet_format{number}", sql)
    def parsed(spark, d):
        rows = SH.parse_sheets(sheets(spark, d))
        return rows.where((F.col("detected_format") == f"FORMAT{number}") & (F.col("status") != "REVIEW")).select(*_FIELDS)


for _n in (1, 2, 3, 4):
    _layout(_n)


@query("sheet_status_counts", f"""{WITH}, {PARSED_SQL},
review AS (SELECT 'sheet-' || sheet || '.txt' AS source_file, count(*) AS review FROM shown
  WHERE layout = 0 AND date_of_birth IS NULL GROUP BY ALL),
files AS (SELECT DISTINCT 'sheet-' || sheet || '.txt' AS source_file, 'FORMAT' || (layout + 1) AS detected_format FROM shown),
good AS (SELECT source_file, count(*) AS n, count_if(status = 'PARSED') AS parsed,
  count_if(status = 'INCOMPLETE') AS incomplete FROM parsed GROUP BY ALL)
SELECT source_file, detected_format, 'SUCCESS' AS status, coalesce(n, 0) + coalesce(review, 0) AS result_count,
  coalesce(parsed, 0) AS parsed, coalesce(incomplete, 0) AS incomplete, coalesce(review, 0) AS review
FROM files LEFT JOIN good USING (source_file) LEFT JOIN review USING (source_file)""")
def sheet_status_counts(spark, d):
    texts = stored_sheets(spark, d)
    return SH.source_counters(texts, SH.parse_sheets(texts)).drop("error")


@query("parser_totals", f"""{WITH}, {PARSED_SQL},
files AS (SELECT DISTINCT sheet, 'FORMAT' || (layout + 1) AS detected_format FROM shown),
rows AS (SELECT detected_format, status FROM parsed UNION ALL SELECT 'FORMAT1', 'REVIEW' FROM shown
  WHERE layout = 0 AND date_of_birth IS NULL),
good AS (SELECT detected_format, count(*) AS n, count_if(status = 'PARSED') AS parsed,
  count_if(status = 'INCOMPLETE') AS incomplete FROM rows GROUP BY ALL)
SELECT f.detected_format, count(*) AS sources, CAST(0 AS BIGINT) AS failed, max(n) AS rows, max(parsed) AS parsed,
  max(incomplete) AS incomplete FROM files f JOIN good USING (detected_format) GROUP BY 1""")
def parser_totals(spark, d):
    texts = stored_sheets(spark, d)
    return SH.parser_totals(SH.source_counters(texts, SH.parse_sheets(texts)))


_META = """'National ' || CASE sheet % 3 WHEN 0 THEN 'Classic' WHEN 1 THEN 'Equipped' ELSE 'Open' END || ' Meet '
    || (sheet % 7 + 2015)"""


@query("canonical_results", f"""{WITH}, {PARSED_SQL}
SELECT source_file, 'ATH-' || substr(sha256(athlete_name), 1, 16) AS athlete_id, athlete_name, {_META} AS competition,
  CAST(sheet % 7 + 2015 AS INTEGER) AS year, division, weight_class,
  CASE sheet % 3 WHEN 0 THEN 'CLASSIC' WHEN 1 THEN 'EQUIPPED' ELSE 'UNKNOWN' END AS equipment, date_of_birth, team, lot,
  {", ".join(MEASURES)}, place FROM parsed WHERE status = 'PARSED'""")
def canonical_results(spark, d):
    texts = stored_sheets(spark, d)
    rows = C.with_metadata(SH.parse_sheets(texts), C.manifest_index(sheet_manifest(texts)))
    return C.canonical_results(rows).drop("line_no", "resolved_athlete_id", "identity_confidence")


@query("build_counters", f"""{WITH}, {PARSED_SQL}
SELECT (SELECT count(DISTINCT sheet) FROM shown) AS source_count,
  count(DISTINCT CASE WHEN status = 'PARSED' THEN sheet END) AS parsed_source_count,
  count_if(status = 'INCOMPLETE') AS incomplete_count,
  (SELECT count(*) FROM shown WHERE layout = 0 AND date_of_birth IS NULL) AS review_count,
  count_if(status = 'PARSED') AS normalized_count FROM parsed""")
def build_counters(spark, d):
    texts = stored_sheets(spark, d)
    return C.build_counters(texts, SH.parse_sheets(texts))


# ---- rows as they are filed now and then ------------------------------------------------------

_KINDS = {k: n for n, k in enumerate(ODD)}


def _odd_sql(kind, where="TRUE", **replaced):
    """Rows of the sheets of one kind; given columns as stated, all others as filed."""
    shown = {c: c for c in ("weight_class", "division", "athlete_name", "bodyweight", *LIFT_BLOCK, "total")} | replaced
    return f"""{WITH}
SELECT 'odd-' || (seq // 64) || '.txt' AS source_file, {", ".join(f"{v} AS {k}" for k, v in shown.items())},
  {"'INCOMPLETE'" if kind == "compact" else "CASE WHEN total IS NULL THEN 'INCOMPLETE' ELSE 'PARSED' END"} AS row_status
FROM meet_results WHERE seq // 64 % {len(ODD)} = {_KINDS[kind]} AND date_of_birth IS NOT NULL AND weight_class <> '120+' AND {where}"""


def _odd(name, kind, sql):
    @query(name, sql)
    def parsed(spark, d):
        rows = SH.parse_sheets(odd_sheets(meet_results(spark, d)).where(F.col("kind") == kind).drop("kind"))
        return rows.select("source_file", "weight_class", "division", "athlete_name", "bodyweight", *LIFT_BLOCK, "total", "row_status")


_odd("compact_rows", "compact", _odd_sql(
    "compact", "best_squat IS NOT NULL AND best_bench IS NOT NULL AND best_deadlift IS NOT NULL",
    **{f"{n}_1": f"best_{n}" for n in LIFTS}, **{f"{n}_{k}": "NULL::DOUBLE" for n in LIFTS for k in (2, 3)}, total="NULL::DOUBLE"))
_odd("unstated_bests", "unstated", _odd_sql("unstated", "squat_2 IS NOT NULL", **{
    f"best_{n}": "greatest(" + ", ".join(f"CASE WHEN {n}_{k} >= 0 THEN {n}_{k} END" for k in (1, 2, 3)) + ")" for n in LIFTS}))
_odd("bare_marks", "bare", _odd_sql("bare", squat_2="NULL::DOUBLE", bench_3="NULL::DOUBLE", deadlift_1="NULL::DOUBLE"))
_odd("inline_classes", "inline", _odd_sql(
    "inline", weight_class="CASE seq % 3 WHEN 0 THEN '93' WHEN 1 THEN '59' ELSE '120+' END"))
_odd("stray_values", "stray", _odd_sql("stray"))
_odd("wrapped_rows", "wrapped", _odd_sql("wrapped"))


@query("sheet_detectors", f"""{WITH},
sheet AS (SELECT DISTINCT seq // 64 AS n FROM meet_results WHERE date_of_birth IS NOT NULL AND weight_class <> '120+'),
layouts AS (SELECT 'odd-' || n || '.txt' AS source_file, n % {len(ODD)} AS kind FROM sheet)
SELECT source_file, CASE kind WHEN {_KINDS['stray']} THEN 'FORMAT4' WHEN {_KINDS['compact']} THEN 'FORMAT1' WHEN {_KINDS['unstated']} THEN 'FORMAT1'
    ELSE 'FORMAT2' END AS detected_format,
  CASE WHEN kind IN ({_KINDS['bare']}, {_KINDS['inline']}, {_KINDS['stray']}) THEN 'FORMAT2' ELSE 'FORMAT1' END AS older_choice,
  kind = {_KINDS['wrapped']} AS wrapped FROM layouts""")
def sheet_detectors(spark, d):
    """What the layout test, the older two-way test and the test for wrapped rows say of every odd sheet."""
    texts = odd_sheets(meet_results(spark, d))
    return SH.detect_sheets(texts.select("source_file", "text")).select(
        "source_file", "detected_format", SH.simple_parser(F.col("text")).alias("older_choice"),
        F.expr(SH.has_wrapped_row("`text`")).alias("wrapped"))


@query("incremental_build", f"""{WITH}, {PARSED_SQL},
sheet AS (SELECT DISTINCT sheet FROM shown)
SELECT (SELECT count_if(sheet % 3 = 0) FROM sheet) AS parsed, (SELECT count_if(sheet % 3 <> 0) FROM sheet) AS kept,
  (SELECT count_if(sheet % 3 = 0 AND sheet % 2 = 0) FROM sheet) + 1 AS dropped, 0::BIGINT AS parsed_again,
  (SELECT count(DISTINCT sheet) FROM shown) AS source_count,
  count(DISTINCT CASE WHEN status = 'PARSED' THEN sheet END) AS parsed_source_count,
  count_if(status = 'INCOMPLETE') AS incomplete_count,
  (SELECT count(*) FROM shown WHERE layout = 0 AND date_of_birth IS NULL) AS review_count,
  count_if(status = 'PARSED') AS normalized_count FROM parsed""")
def incremental_build(spark, d):
    """Three runs: sheets of which a sixth are doubled, a sixth are missing and one is foreign; the sheets as they are; the same again."""
    texts = stored_sheets(spark, d)
    number = F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint")
    texts = texts.drop("detected_format")
    old = texts.where(~((number % 3 == 0) & (number % 2 == 1))).withColumn(
        "text", F.when(number % 3 == 0, F.concat_ws("\n", "text", "text")).otherwise(F.col("text")))
    foreign = spark.range(1).select(F.lit("foreign.txt").alias("source_file"), F.lit("no sheet").alias("text"))
    folder = fresh_folder(spark, "incremental")
    IN.refresh(old.select("source_file", "text").unionByName(foreign), folder)
    changed, again = (IN.refresh(texts.select("source_file", "text"), folder) for _ in range(2))
    counters = C.build_counters(IN.current_sources(spark, folder), IN.current_rows(spark, folder))
    return counters.select(*[F.lit(changed[c]).cast("bigint").alias(c) for c in ("parsed", "kept", "dropped")],
                           F.lit(again["parsed"]).cast("bigint").alias("parsed_again"), "*")


@query("manifest_join", """
WITH files AS (SELECT DISTINCT o_orderkey // 64 AS sheet FROM orders)
SELECT 'sheet-' || sheet || '.txt' AS source_file, """ + _META + """ AS meet,
  'Season ' || (sheet % 7 + 2015) AS meet_year FROM files""")
def manifest_join(spark, d):
    number = F.floor(F.col("o_orderkey") / 64)
    files = table(spark, d, "orders").select(
        F.concat(F.lit("sheet-"), number.cast("string"), F.lit(".txt")).alias("source_file")).distinct()
    return C.with_metadata(files, C.manifest_index(sheet_manifest(files)))


_REPEAT = "source_file, upper(athlete_name), weight_class, division, bodyweight, total"
# each sheet is read twice over: its text follows itself once more
_TWICE = f"""{WITH}, {PARSED_SQL},
twice AS (SELECT * FROM parsed UNION ALL SELECT * FROM parsed),
review AS (SELECT count(*) * 2 AS n FROM shown WHERE layout = 0 AND date_of_birth IS NULL)"""


def doubled(spark, d):
    texts = stored_sheets(spark, d, "concat_ws('\\n', text, text)")
    return texts, SH.parse_sheets(texts)


@query("validation_report", f"""{_TWICE}
SELECT (SELECT count(DISTINCT sheet) FROM shown) AS total_sources,
  (SELECT count(DISTINCT sheet) FROM shown) AS successful_sources, CAST(0 AS BIGINT) AS failed_sources,
  count(*) AS total_rows, count_if(status = 'PARSED') AS parsed_rows, count_if(status = 'INCOMPLETE') AS incomplete_rows,
  (SELECT n FROM review) AS review_rows,
  count_if(best_squat + best_bench + best_deadlift <> total) AS total_mismatches,
  CAST(0 AS BIGINT) AS missing_weight_class, CAST(0 AS BIGINT) AS missing_division,
  CAST(0 AS BIGINT) AS invalid_bodyweight, CAST(0 AS BIGINT) AS invalid_best_lifts, CAST(0 AS BIGINT) AS invalid_total,
  count(*) - count(DISTINCT ({_REPEAT})) AS duplicate_rows FROM twice""")
def validation_report(spark, d):
    texts, rows = doubled(spark, d)
    return Q.validation_report(rows, SH.sheet_sources(texts))


@query("validation_issues", f"""{_TWICE},
repeats AS (SELECT source_file, count(*) - count(DISTINCT ({_REPEAT})) AS n FROM twice GROUP BY 1)
SELECT source_file, 'DUPLICATE_ROW' AS issue_type, n AS issues FROM repeats WHERE n > 0
UNION ALL SELECT source_file, 'TOTAL_MISMATCH', count(*) FROM twice
  WHERE best_squat + best_bench + best_deadlift <> total GROUP BY 1
UNION ALL SELECT 'sheet-' || sheet || '.txt', 'MISSING_ROW', count(*) * 2 FROM shown
  WHERE layout = 0 AND date_of_birth IS NULL GROUP BY 1""")
def validation_issues(spark, d):
    texts, rows = doubled(spark, d)
    return Q.validation_issues(pinned(rows), SH.sheet_sources(texts)).groupBy("source_file", "issue_type").agg(
        F.count(F.lit(1)).alias("issues"))


@query("document_formats", "SELECT doc_id, 'UNKNOWN' AS detected_format FROM documents")
def document_formats(spark, d):
    return SH.detect_sheets(texts(spark, d, "documents").select("doc_id", "text")).drop("text")
