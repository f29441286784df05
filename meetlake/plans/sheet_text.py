"""Filed results written out as sheet text, to feed the extraction with any amount of data.

A sheet holds the results of 64 consecutive orders, so a sheet is a bounded group whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.schema import LIFTS

PER_SHEET = 64
# fixed values: column headers of the four layouts
_OLD = "SQ1 SQ2 SQ3 Best [PL] BP1 BP2 BP3 Best [PL] DL1 DL2 DL3 Best [PL]"
_NEW = "SQ1 SQ2 SQ3 SQ [PL] BP1 BP2 BP3 BP [PL] DL1 DL2 DL3 DL [PL]"
HEADERS = (
    f"Place Name DOB Team Lot Bd. Wt. {_OLD} Total Points",
    f"Place Name DOB Team Lot Bd. Wt. Coeff. {_OLD} Total Points IPF GL Points",
    f"Place Name DOB Team Lot Bd. Wt. Coeff. {_NEW} Total Points IPF GL Points Place",
    f"Place Name YOB Team Lot Bd. Wt. Coeff. {_NEW} Total Points IPF GL Points BL. RK.",
)
# a block the third layout must ignore: wrong gender, then a summary table
_IGNORED = ("Women\nOpen - 57kg\n1 SOMEONE ELSE 01-02-1990 KAR 3 56.00 0.5 100.0 105.0 110.0 110.0 [1] 50.0 55.0 60.0 60.0 [1] "
            "120.0 125.0 130.0 130.0 [1] 300.0 12 50.0 1\nMen\nBest Lifter - Open\n"
            "1 BEST MAN 01-02-1990 KAR 3 56.00 0.5 100.0 105.0 110.0 110.0 50.0 55.0 60.0 60.0 120.0 125.0 130.0 130.0 300.0 1")


def sheet_number(seq: Column) -> Column:
    return F.floor(seq / PER_SHEET)


def _number(c: Column) -> Column:
    shown = F.when(c < 0, F.concat(F.lit("X"), F.abs(c).cast("string"))).otherwise(c.cast("string"))
    return F.coalesce(shown, F.lit("-"))


def _line(layout: Column) -> Column:
    c = F.col
    groups = [F.concat_ws(" ", *[_number(c(f"{lift}_{k}")) for k in (1, 2, 3)], _number(c(f"best_{lift}")),
                          F.lit("[1]")) for lift in LIFTS]
    born = F.when(layout == 3, F.substring("date_of_birth", 7, 4)).otherwise(c("date_of_birth"))
    # an unreadable date keeps a first-layout line a complete, if unparseable, row
    born = F.when((layout == 0) & born.isNull(), "00/00/0000").otherwise(born)
    coefficient = F.when(layout > 0, F.lit("0.1465"))
    # every fifth row of the second layout is broken after the name
    gap = F.when((layout == 1) & (c("seq") % 5 == 0), F.lit("\n")).otherwise(F.lit(" "))
    points = F.when(layout == 0, "12").when(layout == 1, "12 65.1").when(layout == 2, "12 65.1 1").otherwise("12 65.1 38")
    head = F.concat_ws(" ", F.coalesce(c("place").cast("string"), F.lit("-")), "athlete_name")
    rest = F.concat_ws(" ", born, "team", "lot", c("bodyweight").cast("string"), coefficient, *groups,
                       _number(c("total")), points)
    return F.concat(head, gap, rest)


def sheet_texts(results: DataFrame) -> DataFrame:
    """Sheets of all four layouts in turn: source_file and text."""
    number = sheet_number(F.col("seq"))
    layout = number % 4
    heading = F.when(layout.isin(0, 1), F.concat("weight_class", F.lit("kg - "), "division")).otherwise(
        F.concat("division", F.lit(" - "), "weight_class", F.lit("kg")))
    # the first layout has no open class
    fit = results.where(~((layout == 0) & (F.col("weight_class") == "120+")))
    lines = fit.select(number.alias("sheet"), layout.alias("layout"), F.struct(
        heading.alias("heading"), "seq", _line(layout).alias("line")).alias("row"))
    grouped = lines.groupBy("sheet", "layout").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    body = F.transform("rows", lambda r, i: F.when(
        (i > 0) & (F.get("rows", i - 1)["heading"] == r["heading"]), r["line"]).otherwise(
        F.concat(r["heading"], F.lit("\n"), r["line"])))
    header = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), F.col("layout").cast("int") + 1)
    opening = F.when(F.col("layout") == 2, F.lit("Men"))
    closing = F.when(F.col("layout") == 2, F.lit(_IGNORED))
    return grouped.select(
        F.concat(F.lit("sheet-"), F.col("sheet").cast("string"), F.lit(".txt")).alias("source_file"),
        F.concat_ws("\n", header, opening, F.array_join(body, "\n"), closing).alias("text"))


#: Sheets of rows as they are filed now and then: the layout of each kind.
ODD = {"compact": 0, "unstated": 0, "bare": 1, "inline": 1, "stray": 3, "wrapped": 0}


def odd_sheets(results: DataFrame) -> DataFrame:
    """Sheets of 64 orders, each of one odd kind, in turn: source_file, text and kind. Rows need a birth date.

    compact: a first-layout row of three singles instead of attempts; unstated: no best stated; bare: attempts that are X, FAIL
    or - alone; inline: a class behind the row that overrules the section's; stray: a fourth-layout row with a value too many
    before the best deadlift; wrapped: no coefficient, but all rows broken behind the name.
    """
    c = F.col
    number = sheet_number(c("seq"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ODD]), (number % len(ODD)).cast("int") + 1)
    fit = results.where(F.col("date_of_birth").isNotNull() & (F.col("weight_class") != "120+")).withColumn("kind", kind).where(
        ((c("kind") != "compact") | (c("best_squat").isNotNull() & c("best_bench").isNotNull() & c("best_deadlift").isNotNull()))
        & ((c("kind") != "unstated") | c("squat_2").isNotNull()))

    def lift(name: str, best: Column) -> Column:
        bare = {"squat": (2, "X"), "bench": (3, "FAIL"), "deadlift": (1, "-")}[name]
        tries = [F.when((c("kind") == "bare") & (k == bare[0]), bare[1]).otherwise(_number(c(f"{name}_{k}"))) for k in (1, 2, 3)]
        stray = F.when((c("kind") == "stray") & F.lit(name == "deadlift"), F.lit("999.5"))
        return F.concat_ws(" ", *tries, stray, best, F.lit("[1]"))

    best = {n: F.when(c("kind") == "unstated", "-").otherwise(_number(c(f"best_{n}"))) for n in LIFTS}
    born = F.when(c("kind") == "stray", F.substring("date_of_birth", 7, 4)).otherwise(c("date_of_birth"))
    coefficient = F.when(c("kind").isin("bare", "inline", "stray"), F.lit("0.1465"))
    points = (F.when(c("kind").isin("compact", "unstated"), "12").when(c("kind") == "stray", "12 65.1 38").otherwise("12 65.1"))
    singles = F.concat_ws(" - ", *[c(f"best_{n}").cast("string") for n in LIFTS], F.lit("- -"))
    values = F.when(c("kind") == "compact", singles).otherwise(
        F.concat_ws(" ", *[lift(n, best[n]) for n in LIFTS], _number(c("total")), points))
    inline = F.when(c("kind") == "inline", F.concat(inline_class(c("seq")), F.lit("kg")))
    gap = F.when(c("kind") == "wrapped", F.lit("\n")).otherwise(F.lit(" "))
    line = F.concat(F.concat_ws(" ", F.coalesce(c("place").cast("string"), F.lit("-")), "athlete_name"), gap, F.concat_ws(
        " ", born, "team", "lot", c("bodyweight").cast("string"), coefficient, values, inline))
    heading = F.when(c("kind") == "stray", F.concat("division", F.lit(" - "), "weight_class", F.lit("kg"))).otherwise(
        F.concat("weight_class", F.lit("kg - "), "division"))
    rows = fit.select(number.alias("sheet"), "kind", F.struct("seq", F.concat(heading, F.lit("\n"), line).alias("line")).alias("row"))
    grouped = rows.groupBy("sheet", "kind").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # 64 at most
    header = F.element_at(F.create_map(*[x for k, n in ODD.items() for x in (F.lit(k), F.lit(HEADERS[n]))]), c("kind"))
    return grouped.select(F.concat(F.lit("odd-"), c("sheet").cast("string"), F.lit(".txt")).alias("source_file"), F.concat_ws(
        "\n", header, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"), "kind")


def inline_class(seq: Column) -> Column:
    return F.when(seq % 3 == 0, "93").when(seq % 3 == 1, "59").otherwise("120+")


def sheet_manifest(sheets: DataFrame) -> DataFrame:
    """A manifest for the rendered sheets: file names in upper case, meet names by sheet number."""
    number = F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint")
    style = F.when(number % 3 == 0, "Classic").when(number % 3 == 1, "Equipped").otherwise("Open")
    year = (number % 7 + 2015).cast("string")
    return sheets.select(
        F.upper(F.regexp_replace("source_file", r"\.txt$", ".pdf")).alias("filename"), F.lit(None).cast("string").alias("local_path"),
        F.concat(F.lit("Season "), year).alias("year"),
        F.concat(F.lit("National "), style, F.lit(" Meet "), year).alias("competition"), number.alias("position"))
