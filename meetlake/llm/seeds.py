"""Repeated fixed-length windows of words or bytes, found from sparse seeds.

Two texts that share a window of ``window`` units also share the seed that the window holds: of the ``seed``-unit
spans inside a window the one with the least hash, leftmost of equals. The choice depends on the window's content alone,
so equal windows choose equal seeds at the same place. Consecutive windows mostly choose the same seed, so a text has
about ``2 / (window - seed + 2)`` seeds a unit. Of each seed the scan keeps

* ``lead``, a hash of the seed,
* ``context``, a hash of the whole stretch that the windows of the seed cover, and
* ``at`` and ``run``: the first of these windows and how many there are, and ``back``: how far the seed lies behind it.

A window can occur twice only if its seed does. All windows of a context that occurs twice repeat. Where a seed has several
contexts, their windows are compared in blocks, and in the end one by one; a context that occurs often needs that in one
place only, for the sake of the others. Blocks are counted from the seed, so equal windows lie in equal blocks. A block has a
core, which all its windows hold, and a hull, which they cover: with a core that occurs once none of them repeats, with
a hull that occurs twice they all do. Which comparison is used is the business of the two operators.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlake.llm.shared import (
    _BYTE_VALUE, _BYTES, Rolling, as_long, list_array, row_key, sliding_min, staged, text_parts, word_hashes, words_of,
)

_LISTS = {"lead": "bigint", "context": "bigint", "at": "int", "run": "int", "back": "int"}
_DOUBLE = {"left": "bigint", "right": "bigint"}
_FIRST = {"first": "bigint"}


def sequence(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[Rolling, np.ndarray, np.ndarray]:
    """Span hashes, the 64-bit values and each text's first unit, over words or bytes."""
    if unit == "byte":
        values = _BYTE_VALUE[data]
        return Rolling(values, _BYTES), values, offsets
    starts, ends, bounds = words_of(data, offsets)
    values = word_hashes(data, starts, ends)
    return Rolling(values), values, bounds


def first_bytes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a signed number that sorts as the bytes do."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    value = np.zeros(len(at), np.uint64)
    for k in range(8):
        value = (value << np.uint64(8)) | padded[at + k].astype(np.uint64)
    return (value ^ np.uint64(1 << 63)).view(np.int64)


def seeds_of(roll: Rolling, bounds: np.ndarray, window: int, seed: int):
    """Text, seed place, first window and last window of every seed."""
    count = len(roll.sums) - 1
    none = np.zeros(0, np.int64)
    if count < window:
        return none, none, none, none
    grams = roll.windows(seed)
    # the upper half of the hash, then the place: always the same bits, so the choice depends on the window alone
    half = np.uint64(32)
    least = sliding_min(((grams >> half) << half) | np.arange(len(grams), dtype=np.uint64), window - seed + 1)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + window <= ends)
    if not len(starts):
        return none, none, none, none
    place = (least[starts] & np.uint64(2**32 - 1)).astype(np.int64)
    turn = np.flatnonzero(place[1:] != place[:-1]) + 1
    first, last = starts[np.concatenate(([0], turn))], starts[np.concatenate((turn - 1, [len(starts) - 1]))]
    return np.searchsorted(bounds, first, "right") - 1, place[np.concatenate(([0], turn))], first, last


def scan(docs: DataFrame, id_col: str, text_col: str, unit: str, window: int, seed: int, doubled: bool = False) -> DataFrame:
    """One row per document with its length, its whole digest and its seeds, staged.

    Over bytes ``lead`` is 32 bits of its hash: beside ``first``, the seed's first eight bytes, it only has to tell seeds apart
    well enough that few are compared in vain. ``doubled`` adds hashes of the spans of twice a seed's length that start with the seed or end with it (0 where the
    text is too short). For bytes, ``first`` has the seed's first eight bytes.
    """
    lists = _LISTS | (_DOUBLE if doubled else {}) | (_FIRST | {"lead": "int"} if unit == "byte" else {})
    schema = "k1 bigint, k2 bigint, doc_id bigint, n_units bigint, digest string, " + ", ".join(
        f"{k} array<{v}>" for k, v in lists.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_parts(batch.column("text")):
                roll, _, bounds = sequence(unit, data, offsets)
                text, place, first, last = seeds_of(roll, bounds, window, seed)
                stop = np.searchsorted(text, np.arange(high - low), "right")
                leads = roll.spans(place, place + seed)
                digests = [hashlib.sha256(whole(unit, data[a:b].tobytes())).hexdigest()
                           for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [*(batch.column(k).slice(low, high - low) for k in ("k1", "k2", "doc_id")),
                           pa.array(np.diff(bounds), pa.int64()), pa.array(digests),
                           list_array((as_long(leads) >> 32).astype(np.int32), stop, pa.int32()) if unit == "byte"
                           else list_array(as_long(leads), stop, pa.int64()),
                           list_array(as_long(roll.spans(first, last + window)), stop, pa.int64()),
                           list_array((first - bounds[text]).astype(np.int32), stop, pa.int32()),
                           list_array((last - first + 1).astype(np.int32), stop, pa.int32()),
                           list_array((place - first).astype(np.int32), stop, pa.int32())]
                if doubled:
                    back, ahead = place - seed, place + 2 * seed
                    fits = [back >= bounds[text], ahead <= bounds[text + 1]]
                    left = roll.spans(np.where(fits[0], back, place), place + seed)
                    right = roll.spans(place, np.where(fits[1], ahead, place))
                    columns += [list_array(as_long(np.where(f, h, np.uint64(0))), stop, pa.int64())
                                for f, h in zip(fits, (left, right), strict=True)]
                if unit == "byte":
                    columns.append(list_array(first_bytes(data, place), stop, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "doc_id", "n_units", "digest", *lists])

    rows = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(run, schema), f"{unit}-seeds")


def whole(unit: str, text: bytes) -> bytes:
    return text if unit == "byte" else b" ".join(text.split())


def facts(scanned: DataFrame) -> DataFrame:
    """What a scan says of the documents themselves, staged, so that the seeds can be discarded."""
    return staged(scanned.select("k1", "k2", "doc_id", "n_units", "digest"), "facts")


def seed_rows(scanned: DataFrame) -> DataFrame:
    names = [c for c in scanned.columns if c in _LISTS | _DOUBLE | _FIRST]
    return scanned.select("k1", "k2", F.inline(F.arrays_zip(*names)))


_BLOCKS = {"at": "int", "run": "int", "first": "bigint", "core": "bigint", "hull": "bigint"}


def compare_blocks(texts: DataFrame, live: DataFrame, unit: str, window: int, block: int, whole: bool = True) -> DataFrame:
    """The texts that have live runs of windows, and the blocks of these runs that are yet to compare, staged.

    ``texts`` has k1, k2 and text; ``live`` has k1, k2, at, run, back, whole (all windows repeat) and compare. One row per
    text with a live run. Without ``whole`` the texts and the runs that repeat whole are left out.
    """
    schema = "k1 bigint, k2 bigint, " + "text string, whole_at array<int>, whole_run array<int>, " * whole + ", ".join(
        f"block_{k} array<{v}>" for k, v in _BLOCKS.items())
    names = ["k1", "k2", *(("text", "whole_at", "whole_run") if whole else ()), *(f"block_{k}" for k in _BLOCKS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            cut, flat = runs.offsets.to_numpy(), runs.values
            fields = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("at", "run", "back", "whole", "compare")}
            for low, high, data, offsets in text_parts(batch.column("text")):
                roll, values, bounds = sequence(unit, data, offsets)
                text = np.repeat(np.arange(high - low), np.diff(cut[low:high + 1]))
                at, length, back, full, part = (fields[k][cut[low]:cut[high]] for k in ("at", "run", "back", "whole", "compare"))
                full, part = full.astype(bool), np.flatnonzero(part.astype(bool))
                # cut the run of windows at -> at + length where the distance to the seed passes a multiple of block
                reach = back[part].astype(np.int64)
                lead = np.minimum(reach % block + 1, length[part])
                count = 1 + -(-(length[part] - lead) // block)
                owner = np.repeat(np.arange(len(part)), count)
                turn = _ramps(count)
                start = np.where(turn == 0, 0, lead[owner] + (turn - 1) * block)
                stop = np.minimum(lead[owner] + turn * block, length[part][owner])
                own_text = text[part][owner]
                local = at[part][owner].astype(np.int64) + start
                place, size = local + bounds[own_text], stop - start
                whole_stop = np.searchsorted(text[full], np.arange(high - low), "right")
                block_stop = np.searchsorted(own_text, np.arange(high - low), "right")
                kept = [batch.column("text").slice(low, high - low), list_array(at[full], whole_stop, pa.int32()),
                        list_array(length[full], whole_stop, pa.int32())] if whole else []
                # the core is that of the full block, also where a text has only some of its windows
                inner = place + (reach[owner] - start) % block
                first = first_bytes(data, inner) if unit == "byte" else as_long(values[inner])
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(low, high - low) for k in ("k1", "k2")), *kept,
                    list_array(local.astype(np.int32), block_stop, pa.int32()),
                    list_array(size.astype(np.int32), block_stop, pa.int32()), list_array(first, block_stop, pa.int64()),
                    list_array(as_long(roll.spans(inner, inner - block + 1 + window)), block_stop, pa.int64()),
                    list_array(as_long(roll.spans(place, place + size - 1 + window)), block_stop, pa.int64())], names)

    # a set: rows that repeat id and text share a key, and what is said of one is said of all
    per_text = live.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "run", "back", "whole", "compare")).alias("runs"))
    joined = texts.join(per_text, ["k1", "k2"]).select("k1", "k2", "text", "runs")
    return staged(joined.mapInArrow(run, schema), f"{unit}-blocks")


def _ramps(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))


def block_rows(compared: DataFrame) -> DataFrame:
    names = [f"block_{k}" for k in _BLOCKS]
    rows = compared.select("k1", "k2", F.inline(F.arrays_zip(*names)))
    return rows.withColumnsRenamed({f"block_{k}": k for k in _BLOCKS})


def cut(compared: DataFrame, hits: DataFrame, unit: str, window: int) -> DataFrame:
    """Per text with a live seed: how much goes, in how many runs, the digest of the rest, the rest, and the longest run.

    ``hits`` has k1, k2, at and run of the windows that repeat. Rows that repeat a key are returned once.
    """
    schema = ("k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, longest_span bigint, kept_digest string, "
              "kept_text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, whole_at, whole_run, hit in zip(*(batch.column(k) for k in ("text", "whole_at", "whole_run", "hit")),
                                                      strict=True):
                raw = (text.as_py() or "").encode()
                parts = raw if unit == "byte" else raw.split()
                change = np.zeros(len(parts) + 1, np.int32)
                starts = np.array(whole_at.values.to_numpy() if whole_at.is_valid else [], np.int64)
                ends = starts + (whole_run.values.to_numpy() if whole_run.is_valid else 0) - 1 + window
                if hit.is_valid:
                    more, run_ = (hit.values.field(k).to_numpy().astype(np.int64) for k in ("at", "run"))
                    starts, ends = np.concatenate((starts, more)), np.concatenate((ends, more + run_ - 1 + window))
                np.add.at(change, starts, 1)
                np.add.at(change, ends, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                kept = (np.frombuffer(raw, np.uint8)[~gone].tobytes() if unit == "byte"
                        else b" ".join(compress(parts, (~gone).tolist())))
                rows.append((int(gone.sum()), len(edges) // 2, int((edges[1::2] - edges[::2]).max(initial=0)),
                             hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            names = ["n_removed", "n_spans", "longest_span", "kept_digest", "kept_text"]
            columns = [pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)
            ] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *columns], ["k1", "k2", *names])

    per_text = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "run")).alias("hit"))
    joined = compared.select("k1", "k2", "text", "whole_at", "whole_run").join(per_text, ["k1", "k2"], "left")
    return joined.mapInArrow(run, schema).dropDuplicates(["k1", "k2"])
