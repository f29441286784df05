"""One result line into its fields, for each of the four layouts.

Every layout is an expression over the tokens of a line and their numeric values, both computed once
per line. The expressions are SQL text (see functions.arrays).
"""

from __future__ import annotations

from collections.abc import Callable

from meetlake.functions.arrays import each, first_index, indexes, let
from meetlake.functions.numbers import SIGNED_NUMBER
from meetlake.functions.text import squash_sql
from meetlake.schema import LIFT_BLOCK, LIFTS

# fixed values: token shapes
DIGITS = r"r'^\d+$'"
BIRTH_DATE = r"r'^\d{2}-\d{2}-\d{4}$'"
BIRTH_YEAR = r"r'^(?:19\d{2}|20\d{2}|2100)$'"
RANKED = r"r'^(?:-|\d+)$'"
GROUP_MARK = r"r'^\[\d+\]$'"

ROW_TYPE = {
    "place": "int", "athlete_name": "string", "date_of_birth": "string", "team": "string", "lot": "string",
    "bodyweight": "double", **{c: "double" for c in LIFT_BLOCK}, "total": "double", "status": "string",
}


def _is(token: str, pattern: str) -> str:
    """Whether a token is a birth date or year; by its length, most tokens need no pattern."""
    return f"(char_length({token}) = {10 if pattern == BIRTH_DATE else 4} AND {token} RLIKE {pattern})"


def number(token: str) -> str:
    """Signed value of a token: a leading X marks a failed attempt and turns the sign, other text is null."""
    value = f"try_cast(translate({token}, '_xX', '') AS double)"
    return (f"CASE WHEN {token} RLIKE r'{SIGNED_NUMBER}' THEN "
            f"CASE WHEN left({token}, 1) IN ('x', 'X') THEN 0.0D - {value} ELSE {value} END END")


def row_struct(**fields: str) -> str:
    """Row with every field in the fixed order and type; fields not given are null."""
    return "named_struct(" + ", ".join(
        f"'{n}', CAST({fields.get(n, 'NULL')} AS {t})" for n, t in ROW_TYPE.items()) + ")"


def _join(t: str, start: str, stop: str) -> str:
    """Tokens of a half-open zero-based range as one text."""
    return f"array_join(slice({t}, {start} + 1, greatest({stop} - ({start}), 0)), ' ')"


def _identity(t: str, v: str, anchor: str, lot: str, full: bool) -> dict[str, str]:
    """Place, name and bodyweight; with ``full`` also birth date, team and lot."""
    out = {"place": f"CASE WHEN get({t}, 0) RLIKE {DIGITS} THEN try_cast(get({t}, 0) AS int) END",
           "athlete_name": _join(t, "1", anchor), "bodyweight": f"get({v}, {lot} + 1)"}
    if full:
        out |= {"date_of_birth": f"get({t}, {anchor})", "team": _join(t, f"{anchor} + 1", lot), "lot": f"get({t}, {lot})"}
    return out


def _lifts(value: Callable[[int], str], best: Callable[[list[str]], str], deadlift_best: str | None = None) -> dict[str, str]:
    """Three groups of three attempts and a best from twelve values in a row."""
    out = {}
    for g, lift in enumerate(LIFTS):
        four = [value(4 * g + i) for i in range(4)]
        if lift == "deadlift" and deadlift_best is not None:
            four[3] = deadlift_best
        out |= {f"{lift}_{k + 1}": four[k] for k in range(3)} | {f"best_{lift}": best(four)}
    return out


def _with_total(common: dict[str, str], lifts: dict[str, str], total: str) -> str:
    return row_struct(**common, **lifts, total=total,
                      status=f"CASE WHEN {total} IS NULL THEN 'INCOMPLETE' ELSE 'PARSED' END")


def _source_best(four: list[str]) -> str:
    return four[3]


def _best_or_attempts(four: list[str]) -> str:
    """The stated best, else the best successful attempt."""
    return f"coalesce({four[3]}, " + "greatest(" + ", ".join(f"CASE WHEN {a} >= 0 THEN {a} END" for a in four[:3]) + "))"


def _unmarked(t: str, start: str) -> str:
    """Indexes from ``start`` on whose token is no [place] mark."""
    return indexes(t, lambda x, i: f"{i} >= {start} AND NOT (startswith({x}, '[') AND endswith({x}, ']'))")


def _row_1(t: str, v: str) -> str:
    def with_lot(born: str, lot: str) -> str:
        common = _identity(t, v, born, lot, full=True)

        def rows(k: str) -> str:
            text = lambda i: f"get({t}, get({k}, {i}))"
            value = lambda i: f"get({v}, get({k}, {i}))"
            compact = (f"size({k}) >= 4 AND {text(0)} <> '-' AND {text(1)} = '-' AND {text(2)} <> '-' AND {text(3)} = '-'")
            singles = {"squat": value(0), "bench": value(2), "deadlift": value(4)}
            short = row_struct(**common, status="'INCOMPLETE'", **{f"{n}_1": c for n, c in singles.items()},
                               **{f"best_{n}": c for n, c in singles.items()})
            return f"CASE WHEN {compact} THEN {short} ELSE {_with_total(common, _lifts(value, _best_or_attempts), value(12))} END"

        return let(_unmarked(t, f"({lot} + 2)"), rows)

    def with_birth(born: str) -> str:
        lot = first_index(t, lambda x, i: f"{i} > {born} AND {i} < size({t}) - 1 AND get({v}, {i} + 1) IS NOT NULL "
                                          f"AND {x} RLIKE {DIGITS}")
        return let(lot, lambda at: f"CASE WHEN {at} IS NOT NULL AND {born} > 1 THEN {with_lot(born, at)} END")

    born = first_index(t, lambda x, i: f"{i} BETWEEN 1 AND 11 AND {_is(x, BIRTH_DATE)}")
    row = let(born, with_birth)
    return f"coalesce(CASE WHEN size({t}) >= 8 THEN {row} END, {row_struct(status=chr(39) + 'REVIEW' + chr(39))})"


def _row_2(t: str, v: str) -> str:
    def mark(i: str) -> str:
        return f"CAST(coalesce(get({t}, {i}) RLIKE {GROUP_MARK}, false) AS int)"

    def plain(i: str) -> str:
        return f"NOT get({t}, {i}) RLIKE '^[xX]'"

    def with_lot(born: str, lot: str) -> str:
        common = _identity(t, v, born, lot, full=True)
        coefficient = f"get({v}, {lot} + 2)"
        start = (f"{lot} + 2 + CAST(coalesce({coefficient} > 0 AND {coefficient} < 2.0 AND {plain(f'{lot} + 2')}, false) AS int)")

        def from_squat(s: str) -> str:
            return let(f"{s} + 4 + {mark(f'{s} + 4')}", lambda b: let(
                f"{b} + 4 + {mark(f'{b} + 4')}", lambda d: let(f"{d} + 4 + {mark(f'{d} + 4')}", lambda e: finish(s, b, d, e))))

        def finish(s: str, b: str, d: str, e: str) -> str:
            at = (s, b, d)
            lifts = _lifts(lambda i: f"get({v}, {at[i // 4]} + {i % 4})", _source_best)
            return (f"CASE WHEN size({t}) - {s} >= 12 AND {d} + 4 <= size({t}) THEN "
                    f"{_with_total(common, lifts, f'get({v}, {e})')} END")

        return let(start, from_squat)

    def with_birth(born: str) -> str:
        lot = first_index(t, lambda x, i: f"{i} > {born} AND {i} < least(size({t}) - 1, {born} + 13) "
                                          f"AND get({v}, {i} + 1) > 0 AND {x} RLIKE {DIGITS} AND {plain(f'{i} + 1')}")
        return let(lot, lambda at: f"CASE WHEN {at} IS NOT NULL THEN {with_lot(born, at)} END")

    born = first_index(t, lambda x, i: _is(x, BIRTH_DATE))
    row = let(born, lambda b: f"CASE WHEN {b} > 1 THEN {with_birth(b)} END")
    return f"CASE WHEN size({t}) >= 10 AND get({t}, 0) RLIKE {RANKED} THEN {row} END"


def _row_anchored(t: str, v: str, anchor: str, values: Callable[[dict[str, str], str], str]) -> str:
    """Rows of the later layouts: name up to the anchor, then lot, bodyweight and coefficient."""
    def with_anchor(a: str) -> str:
        lot = first_index(t, lambda x, i: f"{i} > {a} AND {i} < size({t}) - 2 AND get({v}, {i} + 1) IS NOT NULL "
                                          f"AND get({v}, {i} + 2) IS NOT NULL AND {x} RLIKE {DIGITS}")
        return let(lot, lambda at: f"CASE WHEN {at} IS NOT NULL AND {a} > 1 THEN " + let(
            _unmarked(t, f"({at} + 3)"), lambda k: values(_identity(t, v, a, at, full=False), k)) + " END")

    spot = first_index(t, lambda x, i: f"{i} BETWEEN 1 AND 14 AND {_is(x, anchor)}")
    return (f"CASE WHEN size({t}) >= 10 AND get({t}, 0) RLIKE {RANKED} THEN "
            + let(spot, lambda a: f"CASE WHEN {a} IS NOT NULL THEN {with_anchor(a)} END") + " END")


def _row_3(t: str, v: str) -> str:
    def values(common: dict[str, str], k: str) -> str:
        value = lambda i: f"get({v}, get({k}, {i}))"
        return _with_total(common, _lifts(value, _source_best), value(12))
    return _row_anchored(t, v, BIRTH_DATE, values)


def _row_4(t: str, v: str) -> str:
    def values(common: dict[str, str], k: str) -> str:
        value = lambda i: f"get({v}, get({k}, {i}))"
        # a row of 17 or more values has a stray one before the best deadlift
        extra = f"CAST(size({k}) >= 17 AS int)"
        return _with_total(common, _lifts(value, _source_best, value(f"11 + {extra}")), value(f"12 + {extra}"))
    return _row_anchored(t, v, BIRTH_YEAR, values)


_ROWS = {"FORMAT1": _row_1, "FORMAT2": _row_2, "FORMAT3": _row_3, "FORMAT4": _row_4}


def parse_row_sql(layout: str, line: str) -> str:
    """The row struct of a line by layout label; null when the line holds no row."""
    def by_layout(t: str, v: str) -> str:
        return "CASE " + " ".join(f"WHEN {layout} = '{n}' THEN {rule(t, v)}" for n, rule in _ROWS.items()) + " END"
    return let(f"split({squash_sql(line)}, ' ')", lambda t: let(each(t, number), lambda v: by_layout(t, v)))
