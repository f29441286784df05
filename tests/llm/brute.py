"""Plain single-process versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def repeated(units: list, window: int) -> list[list[bool]]:
    """For every sequence, which of its units lie in a window that starts more than once anywhere."""
    seen = Counter(bytes(u[i:i + window]) if isinstance(u, bytes) else tuple(u[i:i + window])
                   for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[bytes(u[i:i + window]) if isinstance(u, bytes) else tuple(u[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append(gone)
    return out


def runs(gone: list[bool]) -> int:
    return sum(g and not p for g, p in zip(gone, [False, *gone]))


def cut_words(rows: list[tuple], window: int = 35) -> list[tuple]:
    """(id, words, words removed, digest of the rest) of (id, text) rows."""
    units = [words(t) for _, t in rows]
    return sorted((i, len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g) if not x)).hexdigest())
                  for (i, _), u, g in zip(rows, units, repeated(units, window)))


def cut_bytes(rows: list[tuple], window: int = 200) -> list[tuple]:
    units = [(t or "").encode() for _, t in rows]
    return sorted((i, len(u), sum(g), runs(g), hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest())
                  for (i, _), u, g in zip(rows, units, repeated(units, window)))


def simhash(text: str | None, shingle: int = 4) -> int:
    import xxhash
    ws = WORD.findall((text or "").encode().lower())
    if not ws:
        return 0
    grams = [b" ".join(ws[i:i + shingle]) for i in range(max(1, len(ws) - shingle + 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids: list[int], values: list[int], errors: int = 4) -> dict[int, int]:
    """Least id reachable over values that differ in few bits; equal values are joined first."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            if (values[x] ^ values[y]).bit_count() <= errors:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    least = {}
    for x, i in enumerate(ids):
        least[find(x)] = min(i, least.get(find(x), i))
    return {i: least[find(x)] for x, i in enumerate(ids)}
