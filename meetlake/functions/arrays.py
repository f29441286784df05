"""Ordered-array helpers: state that runs over the lines of one text stays inside that text's row.

The helpers return SQL text. A sheet layout is one large expression, and text is parsed in one call
where a tree of column objects would cost thousands.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_names = count(1)


def name(stem: str = "v") -> str:
    """A lambda variable no other lambda uses."""
    return f"{stem}_{next(_names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and hand it to ``body``."""
    v = name()
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def each(items: str, body: Callable[[str], str]) -> str:
    x = name("x")
    return f"transform({items}, {x} -> {body(x)})"


def each_at(items: str, body: Callable[[str, str], str]) -> str:
    x, i = name("x"), name("i")
    return f"transform({items}, ({x}, {i}) -> {body(x, i)})"


def keep(items: str, test: Callable[[str], str]) -> str:
    x = name("x")
    return f"filter({items}, {x} -> {test(x)})"


def known(items: str) -> str:
    return keep(items, lambda x: f"{x} IS NOT NULL")


def indexes(items: str, test: Callable[[str, str], str]) -> str:
    """Ascending zero-based indexes of the items that pass."""
    return known(each_at(items, lambda x, i: f"CASE WHEN {test(x, i)} THEN {i} END"))


def first_index(items: str, test: Callable[[str, str], str]) -> str:
    """Lowest zero-based index whose (item, index) passes, or null."""
    return f"array_min({each_at(items, lambda x, i: f'CASE WHEN {test(x, i)} THEN {i} END')})"


def blocks(items: str, opens: Callable[[str], str], body: Callable[[str], str]) -> str:
    """Cut an array before every opening item, map each block to an array, and join the results.

    Linear in the array: each item is copied into exactly one block.
    """
    def cut(seq: str) -> str:
        def spread(at: str) -> str:
            return "flatten(" + each_at(at, lambda p, j: let(
                f"slice({seq}, {p} + 1, coalesce(get({at}, {j} + 1), size({seq})) - {p})", body)) + ")"
        return let(indexes(seq, lambda x, i: f"{i} = 0 OR {opens(x)}"), spread)
    return let(items, cut)


def carry_forward(items: str, opens: Callable[[str], str], attach: Callable[[str, str], str]) -> str:
    """Give every item the last opening item at or before it: attach(head, item).

    Before the first opening item the head is simply the first item, so ``attach`` tests the head.
    """
    def spread(block: str) -> str:
        return let(f"get({block}, 0)", lambda head: each(block, lambda x: attach(head, x)))
    return blocks(items, opens, spread)
