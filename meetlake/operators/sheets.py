"""Result sheets: one text per source becomes one row per filed result.

A sheet is a single cell, so every state that runs down its lines (section, gender, summary block,
wrapped rows) is resolved by array functions inside that row. The whole extraction is therefore a
narrow job: scan, project, explode, project. Nothing is shuffled, whatever the number of sheets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.functions.arrays import blocks, carry_forward, each, each_at, first_index, keep, let
from meetlake.functions.text import lines_sql, squash, squash_sql
from meetlake.operators.sheet_rows import ROW_TYPE, parse_row_sql

# fixed values: layout patterns of result sheets
DATE_TOKEN = r"(?:^| )\d{2}-\d{2}-\d{4}(?: |$)"
DATE_ANYWHERE = r"\b\d{2}[-/]\d{2}[-/]\d{4}\b"
ROW_START = r"^(?:\d+|-)\s+\S+"
CLASS_BREAK = r"(?i)\b\d+(?:\.\d+)?\s*kg\s*-"
CLASS_THEN_DIVISION = r"\b\d+(?:\.\d+)?\s*(?:\+\s*)?kg\s*-\s*."
DIVISION_THEN_CLASS = r"(?s)^\W*+\w.*?-\s*\d+(?:\.\d+)?\s*(?:\+\s*)?kg\b"
SECTION_1 = r"(?i)^(\d+(?:\.\d+)?)kg\s*-\s*(.+)$"
SECTION_WEIGHT_FIRST = r"^(\d+(?:\.\d+)?|\d+\+)\s*[Kk][Gg]\s*-\s*(.+)$"
SECTION_DIVISION_FIRST = r"^(.+?)\s*-\s*(\d+(?:\.\d+)?|\d+\+)\s*[Kk][Gg]$"
BIRTH_DATE_HEADER = r"\bplace name dob team\b"
BIRTH_YEAR_HEADER = r"\bplace name yob team\b"
FLAT_START = r"^(?:\d+|-) \S"
INLINE_CLASS = r"(?i)(?:^| )(\d+(?:\.\d+)?|\d+\+)kg(?: |$)"
SUMMARY_STARTS = ("best lifter -", "team championship -")
SUMMARY_HEADS = ("place name team", "place team points")

FORMATS = ("FORMAT1", "FORMAT2", "FORMAT3", "FORMAT4")
_LINE = "struct<line:string,weight_class:string,division:string,gender:string>"


# ---- layout detection -------------------------------------------------------------------------

def _has(text: str, pattern: str) -> str:
    """Pattern search where word borders, digits and blanks follow Unicode on every JDK."""
    return f"{text} RLIKE r'(?U){pattern}'"


def _contains(text: str, *parts: str) -> str:
    return "(" + " AND ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def has_class_section(flat: str) -> str:
    return f"({_has(flat, CLASS_THEN_DIVISION)} OR {_has(flat, DIVISION_THEN_CLASS)})"


def has_attempt_header(flat: str) -> str:
    return _contains(flat, "place name dob team", "sq1", "bp1", "dl1")


def has_placed_lifts(flat: str) -> str:
    return _contains(flat, "sq [pl]", "bp [pl]", "dl [pl]")


def has_points_column(flat: str) -> str:
    return _contains(flat, "ipf gl points")


def has_wrapped_row(text: str) -> str:
    """A row start without a date whose next four lines show a date before another start or section."""
    def flags(line: str) -> str:
        start = f"{line} RLIKE r'{ROW_START}'"
        return (f"named_struct('start', {start}, 'dated', {_has(line, DATE_ANYWHERE)}, "
                f"'stop', {start} OR (contains(lower({line}), 'kg') AND {_has(line, CLASS_BREAK)}))")

    def wrapped(seq: str) -> str:
        def test(x: str, i: str) -> str:
            found = "false"
            for ahead in (4, 3, 2, 1):
                near = f"get({seq}, {i} + {ahead})"
                found = f"coalesce({near}.dated OR (NOT {near}.stop AND {found}), false)"
            return f"{x}.start AND NOT {x}.dated AND {found}"
        return f"exists({each_at(seq, test)}, hit -> hit)"

    return let(each(lines_sql(text), flags), wrapped)


def sheet_format(text: str) -> str:
    """Layout label, tested from the most specific layout to the oldest one."""
    def decide(flat: str) -> str:
        coeff = _contains(flat, "coeff.")
        section = has_class_section(flat)
        dob = f"({_contains(flat, 'place name dob team')} AND {_has(flat, BIRTH_DATE_HEADER)})"
        yob = f"({_contains(flat, 'place name yob team')} AND {_has(flat, BIRTH_YEAR_HEADER)})"
        return f"""CASE
          WHEN {yob} AND {coeff} AND {section} THEN 'FORMAT4'
          WHEN {dob} AND {coeff} AND {has_placed_lifts(flat)} AND {has_points_column(flat)} AND {section} THEN 'FORMAT3'
          WHEN NOT {has_attempt_header(flat)} THEN 'UNKNOWN'
          WHEN {dob} AND ({coeff} OR {has_wrapped_row(text)}) AND {section} THEN 'FORMAT2'
          WHEN {_contains(flat, 'total points')} AND NOT {coeff} AND NOT {has_wrapped_row(text)} THEN 'FORMAT1'
          ELSE 'UNKNOWN' END"""
    return let(f"lower({squash_sql(text)})", decide)


def simple_parser(text: Column) -> Column:
    """The older two-way choice between the first two layouts."""
    flat = F.lower(squash(text))
    return F.when(flat.contains("coeff.") & flat.contains("ipf gl points"), F.lit("FORMAT2")).otherwise(
        F.lit("FORMAT1"))


# ---- sections and headers (all over squashed lines) -------------------------------------------

def _section(flat: str, pattern: str, weight: int, division: int, otherwise: str = "NULL") -> str:
    return (f"CASE WHEN NOT contains(lower({flat}), 'kg') THEN NULL WHEN {flat} RLIKE r'{pattern}' THEN "
            f"named_struct('weight_class', regexp_extract({flat}, r'{pattern}', {weight}), "
            f"'division', trim(regexp_extract({flat}, r'{pattern}', {division}))) ELSE {otherwise} END")


def section_first_layout(flat: str) -> str:
    return _section(flat, SECTION_1, 1, 2)


def section_division_first(flat: str) -> str:
    return _section(flat, SECTION_DIVISION_FIRST, 2, 1)


def section_either_order(flat: str) -> str:
    return _section(flat, SECTION_WEIGHT_FIRST, 1, 2, section_division_first(flat))


def is_column_header(flat: str, layout: int) -> str:
    low = f"lower({flat})"
    start = "place name yob team" if layout == 4 else "place name dob team"
    rest = (f"{_contains(low, 'coeff', 'ipf gl points')}" if layout == 2
            else f"{_contains(low, 'coeff.')} AND {has_placed_lifts(low)}")
    return f"(startswith({low}, '{start}') AND {rest})"


def _starts(flat: str, starts) -> str:
    return "(" + " OR ".join(f"startswith(lower({flat}), '{p}')" for p in starts) + ")"


def gender_of(flat: str) -> str:
    return f"CASE lower({flat}) WHEN 'men' THEN 'Men' WHEN 'women' THEN 'Women' END"


# ---- logical lines with their state -----------------------------------------------------------

def _result_line(line: str, section: str, gender: str = "CAST(NULL AS string)") -> str:
    return (f"named_struct('line', {line}, 'weight_class', {section}.weight_class, 'division', {section}.division, "
            f"'gender', {gender})")


def _marked(lines: str, look) -> str:
    """Each line with its marks, computed from the squashed line."""
    return each(lines, lambda line: let(squash_sql(line), lambda flat: look(line, flat)))


def _carry(items: str, opens, fields: dict[str, str]) -> str:
    """carry_forward where each new field is taken from the head (``h``) or the item (``x``)."""
    def attach(head: str, x: str) -> str:
        return "named_struct(" + ", ".join(
            f"'{n}', {rule.format(h=head, x=x)}" for n, rule in fields.items()) + ")"
    return carry_forward(items, opens, attach)


def _lines_with_section(text: str, section_of, skip) -> str:
    """Attach the running section to each line, then drop headings and lines that are no candidates."""
    marked = _marked(lines_sql(text), lambda line, flat: (
        f"named_struct('line', {line}, 'section', {section_of(flat)}, 'skip', {skip(flat)})"))
    held = _carry(marked, lambda x: f"{x}.section IS NOT NULL", {
        "line": "{x}.line", "section": "{h}.section", "skip": "{x}.skip OR {x}.section IS NOT NULL"})
    return each(keep(held, lambda x: f"NOT {x}.skip"), lambda x: _result_line(f"{x}.line", f"{x}.section"))


def lines_layout_1(text: str) -> str:
    found = _lines_with_section(text, section_first_layout, lambda flat: f"NOT {flat} RLIKE r'{ROW_START}'")
    return keep(found, lambda x: f"{x}.weight_class IS NOT NULL")


def lines_layout_4(text: str) -> str:
    return _lines_with_section(text, section_division_first, lambda flat: is_column_header(flat, 4))


def join_wrapped(lines: str) -> str:
    """Rejoin rows broken over several lines.

    A block opens at a row start or a section heading. A block opened by a row start absorbs its
    following lines up to the first one by which the joined row shows a birth date (at least one, when
    there is one); what is left of the block stands alone.
    """
    def look(flat: str) -> str:
        start = f"{flat} RLIKE r'{FLAT_START}'"
        return (f"named_struct('line', {flat}, 'start', {start}, 'opens', {start} OR ({section_either_order(flat)}) "
                f"IS NOT NULL, 'dated', {flat} RLIKE r'{DATE_TOKEN}')")

    def rejoin(block: str) -> str:
        head, extra = f"get({block}, 0)", f"size({block}) - 1"
        dated = first_index(block, lambda x, i: f"{i} > 0 AND {x}.dated")
        last = f"CASE WHEN {head}.dated THEN least(1, {extra}) ELSE coalesce({dated}, {extra}) END"
        texts = f"transform({block}, b -> b.line)"
        joined = let(last, lambda n: (
            f"concat(array(array_join(slice({texts}, 1, {n} + 1), ' ')), slice({texts}, {n} + 2, {extra} - {n} + 1))"))
        return f"CASE WHEN {head}.start AND {extra} > 0 THEN {joined} ELSE {texts} END"

    flat = keep(each(lines, squash_sql), lambda x: f"{x} <> ''")
    return blocks(each(flat, look), lambda x: f"{x}.opens", rejoin)


def lines_layout_2(text: str) -> str:
    def look(flat: str) -> str:
        header, summary, heading = is_column_header(flat, 2), _starts(flat, SUMMARY_STARTS), _starts(flat, SUMMARY_HEADS)
        return let(f"CASE WHEN {header} THEN 'header' WHEN {summary} THEN 'summary' WHEN {heading} THEN 'header' END",
                   lambda kind: let(f"CASE WHEN {kind} IS NULL THEN {section_either_order(flat)} END", lambda section: (
                       f"named_struct('line', {flat}, 'section', {section}, 'summary', coalesce({kind} = 'summary', false), "
                       f"'skip', {kind} IS NOT NULL OR {section} IS NOT NULL)")))

    muted = _carry(each(join_wrapped(lines_sql(text)), look), lambda x: f"{x}.summary OR {x}.section IS NOT NULL", {
        "line": "{x}.line", "section": "{x}.section", "skip": "{x}.skip OR {h}.summary"})
    held = _carry(muted, lambda x: f"{x}.section IS NOT NULL", {
        "line": "{x}.line", "section": "{h}.section", "skip": "{x}.skip"})

    def finish(x: str) -> str:
        line = f"{x}.line"
        own = (f"CASE WHEN contains(lower({line}), 'kg') AND {line} RLIKE r'{INLINE_CLASS}' THEN "
               f"regexp_extract({line}, r'{INLINE_CLASS}', 1) ELSE {x}.section.weight_class END")
        return (f"named_struct('line', {line}, 'weight_class', {own}, 'division', {x}.section.division, "
                "'gender', CAST(NULL AS string))")

    return each(keep(held, lambda x: f"NOT {x}.skip"), finish)


def lines_layout_3(text: str) -> str:
    def look(line: str, flat: str) -> str:
        return let(gender_of(flat), lambda gender: let(
            f"{gender} IS NULL AND {_starts(flat, SUMMARY_STARTS)}", lambda summary: let(
                f"CASE WHEN {gender} IS NULL AND NOT {summary} THEN {section_division_first(flat)} END", lambda section: (
                    f"named_struct('line', {line}, 'gender', {gender}, 'section', {section}, 'summary', {summary}, 'skip', "
                    f"{gender} IS NOT NULL OR {summary} OR {section} IS NOT NULL OR {is_column_header(flat, 3)})"))))

    def states(marked: str) -> str:
        muted = _carry(marked, lambda x: f"{x}.summary OR {x}.section IS NOT NULL OR {x}.gender IS NOT NULL", {
            "line": "{x}.line", "gender": "{x}.gender", "section": "{x}.section", "skip": "{x}.skip OR {h}.summary"})
        gendered = _carry(muted, lambda x: f"{x}.gender IS NOT NULL", {
            "line": "{x}.line", "gender": "{h}.gender", "section": "{x}.section", "skip": "{x}.skip"})
        held = _carry(gendered, lambda x: f"{x}.section IS NOT NULL", {
            "line": "{x}.line", "gender": "{x}.gender", "section": "{h}.section", "skip": "{x}.skip"})
        # without any gender heading the whole sheet counts as men's
        default = f"CASE WHEN NOT exists({marked}, m -> m.gender IS NOT NULL) THEN 'Men' END"
        return let(default, lambda men: each(
            keep(held, lambda x: f"NOT {x}.skip AND coalesce({x}.gender, {men}) = 'Men'"),
            lambda x: _result_line(f"{x}.line", f"{x}.section", "'Men'")))

    return let(_marked(lines_sql(text), look), states)


_LINES = {"FORMAT1": lines_layout_1, "FORMAT2": lines_layout_2,
          "FORMAT3": lines_layout_3, "FORMAT4": lines_layout_4}


# ---- the job ----------------------------------------------------------------------------------

def detect_sheets(sheets: DataFrame, text: str = "text") -> DataFrame:
    """Add ``detected_format``; a null text (unreadable source) is UNKNOWN. Sheets that have the column are as judged before."""
    if "detected_format" in sheets.columns:
        return sheets
    return sheets.select("*", F.expr(f"explode(array(coalesce({sheet_format(f'`{text}`')}, 'UNKNOWN')))").alias(
        "detected_format"))


def result_lines(sheets: DataFrame, source: str = "source_file", text: str = "text") -> DataFrame:
    """Candidate result lines with section, gender and position, straight from the sheet row."""
    judged = [c for c in ("detected_format",) if c in sheets.columns]
    found = detect_sheets(sheets.select(source, text, *judged), text)
    by_layout = " ".join(f"WHEN '{n}' THEN {rule(f'`{text}`')}" for n, rule in _LINES.items())
    lines = f"CAST(CASE detected_format {by_layout} END AS array<{_LINE}>)"
    return (found.select(F.col(source).alias("source_file"), "detected_format", F.expr(f"posexplode({lines})").alias(
        "line_no", "item")).select("source_file", "detected_format", "line_no", "item.*"))


def parse_sheets(sheets: DataFrame, source: str = "source_file", text: str = "text") -> DataFrame:
    """One row per filed result: status, section, raw line and the 19 extracted fields.

    The oldest layout reports lines it cannot read as REVIEW rows and stamps every read row PARSED;
    the later layouts skip unreadable lines and report INCOMPLETE rows as such.
    """
    found = result_lines(sheets, source, text)
    row = parse_row_sql("detected_format", "line")
    rows = found.select("*", F.expr(f"explode(filter(array({row}), r -> r IS NOT NULL))").alias("row"))
    return rows.select(
        "source_file", "detected_format", "line_no",
        F.when(F.col("row.status") == "REVIEW", F.lit("REVIEW"))
        .when(F.col("detected_format") == "FORMAT1", F.lit("PARSED"))
        .otherwise(F.col("row.status")).alias("status"),
        "weight_class", "division", "gender", F.col("line").alias("raw_line"),
        *[F.col(f"row.{name}").alias("row_status" if name == "status" else name) for name in ROW_TYPE])


def sheet_sources(sheets: DataFrame, source: str = "source_file", text: str = "text") -> DataFrame:
    """One row per source: detected format, SUCCESS or ERROR, and the error text."""
    known = F.col("detected_format") != "UNKNOWN"
    return detect_sheets(sheets, text).select(
        F.col(source).alias("source_file"), "detected_format",
        F.when(known, F.lit("SUCCESS")).otherwise(F.lit("ERROR")).alias("status"),
        F.when(~known, F.lit("Unable to detect source format.")).alias("error"))


def source_counters(sheets: DataFrame, rows: DataFrame, source: str = "source_file") -> DataFrame:
    """Per source: rows by status next to the source's own outcome (sources without rows count zero)."""
    per_file = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("result_count"),
        F.count_if(F.col("status") == "PARSED").alias("parsed"),
        F.count_if(F.col("status") == "INCOMPLETE").alias("incomplete"),
        F.count_if(F.col("status") == "REVIEW").alias("review"))
    joined = sheet_sources(sheets, source).join(per_file, "source_file", "left")
    return joined.fillna(0, ["result_count", "parsed", "incomplete", "review"])


def parser_totals(counters: DataFrame) -> DataFrame:
    """Totals by parser over the per-source counters."""
    return counters.groupBy("detected_format").agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("status") == "ERROR").alias("failed"),
        F.sum("result_count").alias("rows"), F.sum("parsed").alias("parsed"),
        F.sum("incomplete").alias("incomplete"))
