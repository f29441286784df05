"""Byte-level substring deduplication over a sparse suffix array.

A byte goes if a string of ``window`` bytes that covers it also starts anywhere else. All suffixes of 100 TB cannot be
sorted with their texts, and need not be: only suffixes that begin at the seeds of ``seeds`` are sorted, about one in
eighty, as every repeated string holds a seed that repeats with it. ``_sorted_groups`` works in three rounds: on the
seeds' suffixes, on those of blocks of windows where a seed's surroundings differ, and on those of the single windows
of the few blocks in which a repeat begins or ends.

* Spark's range partitioner samples splitters and deals the suffixes out by their leading eight bytes, the hash of what
  follows, and last the place, so that a suffix that begins a third of all texts spreads over many buckets.
* Each bucket is sorted locally by multikey quicksort: a key is looked at only among rows that tie in the keys before it.
* Neighbours that tie are one group. The first and the last group of each bucket may go on in the next one, so their
  sums are compared across boundaries: two rows a bucket at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.seeds import block_rows, compare_blocks, cut, facts, keyed_texts, scan, seed_rows
from meetlake.llm.shared import discard, staged, table

WINDOW = 200
SEED = 40
#: Windows that are compared as one before they are compared one by one.
BLOCK = 8
#: Rows that a bucket holds on average at most.
BUCKET_ROWS = 1 << 20


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows by several keys, and the numbers of their groups of equal rows, in that order.

    A later key is read and sorted only within the runs that tie in all earlier ones.
    """
    order = np.argsort(keys[0])
    value = keys[0][order]
    starts = np.concatenate(([True], value[1:] != value[:-1])) if len(order) else np.zeros(0, bool)
    for key in keys[1:]:
        run = np.cumsum(starts)
        tied = np.flatnonzero(~starts | np.concatenate((~starts[1:], [False])))
        if not len(tied):
            break
        # runs stay where they are, so sorting (run, key) permutes rows within runs only
        inner = np.lexsort((key[order[tied]], run[tied]))
        order[tied] = order[tied[inner]]
        value = key[order[tied]]
        starts[tied[1:]] |= value[1:] != value[:-1]
    return order, np.cumsum(starts) - 1


def _sorted_groups(rows: DataFrame, keys: list[str], value: str, n_rows: int) -> DataFrame:
    """The rows (k1, k2, at, run, back) whose keys occur more than once, with two flags over their keys and value (a subgroup).

    ``whole``: the subgroup has several rows. ``compare``: the keys have several values, and the row is its subgroup's
    only or first one (in each bucket).
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // BUCKET_ROWS))
    place = ["k1", "k2", "at", "run", "back"]
    rows = rows.select(*place, *(F.col(k).cast("bigint").alias(f"key{i}") for i, k in enumerate(keys)), F.col(value).alias("value"))
    keys = [f"key{i}" for i in range(len(keys))]
    open_ = [*keys, "value", "n", "least", "most"]
    names = [*place, "whole", "compare", *open_]
    schema = ("k1 bigint, k2 bigint, at int, run int, back int, whole boolean, compare boolean, "
              + ", ".join(f"{c} bigint" for c in open_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        bucket = pa.Table.from_batches(batches).combine_chunks()
        columns = [bucket.column(k).to_numpy() for k in (*keys, "value")]
        order, sub = multikey_order(columns)
        starts = np.flatnonzero(np.concatenate(([True], sub[1:] != sub[:-1])))  # of the subgroups
        size = np.diff(np.append(starts, len(order)))
        turn = np.zeros(len(starts), bool)
        turn[0] = True
        for column in columns[:-1]:
            key = column[order[starts]]
            turn[1:] |= key[1:] != key[:-1]
        group, g_starts, values = np.cumsum(turn) - 1, np.flatnonzero(turn), columns[-1][order[starts]]
        least, most = np.minimum.reduceat(values, g_starts)[group], np.maximum.reduceat(values, g_starts)[group]
        whole = (size > 1)[sub]
        first_one = np.zeros(len(order), bool)
        first_one[starts] = True
        compare = (least != most)[sub] & first_one
        # the bucket's first and last subgroup may go on in the next bucket: one row of each is left open
        ends = np.unique([0, len(starts) - 1])
        opened = np.zeros(len(order), bool)
        opened[starts[ends]] = True
        keep = np.flatnonzero((whole | compare) & ~opened)
        nothing = [pa.nulls(len(keep), pa.int64())] * len(open_)
        settled = [*(bucket.column(c) for c in place)]
        at = pa.array(order[keep])
        yield from pa.Table.from_arrays([*(c.take(at) for c in settled), pa.array(whole[keep]), pa.array(compare[keep]), *nothing],
                                        names).to_batches(max_chunksize=1 << 16)
        at = pa.array(order[starts[ends]])
        none = pa.nulls(len(ends), pa.bool_())
        yield from pa.Table.from_arrays(
            [*(c.take(at) for c in settled), none, none, *(pa.array(c[order[starts[ends]]]) for c in columns),
             pa.array(size[ends]), pa.array(least[ends]), pa.array(most[ends])], names).to_batches()

    dealt = rows.repartitionByRange(parts, *keys, "value", *place)
    done = staged(dealt.mapInArrow(run, schema), "suffix-groups")
    # compared across boundaries: two rows a bucket at most, the proven bound of what is broadcast
    ends = done.where("n is not null").select(*place, *open_)
    subs = ends.groupBy(*keys, "value").agg(F.sum("n").alias("all_n"))
    groups = ends.groupBy(*keys).agg((F.min("least") != F.max("most")).alias("compare"))
    across = (ends.join(F.broadcast(groups), keys).join(F.broadcast(subs), [*keys, "value"])
              .select(*place, (F.col("all_n") > 1).alias("whole"), "compare").where("whole or compare"))
    return done.where("n is null").select(*place, "whole", "compare").unionByName(across)


def _compared(compared: DataFrame) -> DataFrame:
    n_rows = compared.select(F.sum(F.size("block_at"))).first()[0] or 0
    return _sorted_groups(block_rows(compared).withColumn("back", F.lit(0)), ["first", "core"], "hull", n_rows)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, longest_span, kept_sha256 (of the bytes that stay).

    Null counts as empty; texts shorter than the window lose nothing. Repeated rows are documents of their own, so each is
    the other's copy. Cuts fall between bytes, also within a character. Other columns are not looked at.
    """
    if not 8 <= seed <= window:
        raise ValueError("a seed has at least eight bytes and fits into the window")
    scanned = scan(docs, id_col, text_col, "byte", window, seed)
    n_rows = scanned.select(F.sum(F.size("lead"))).first()[0] or 0
    documents = facts(scanned)
    live = _sorted_groups(seed_rows(scanned), ["first", "lead"], "context", n_rows)
    discard(scanned)
    compared = compare_blocks(keyed_texts(docs, id_col, text_col), live, "byte", window, BLOCK)
    blocks = _compared(compared)
    windows = compare_blocks(compared.select("k1", "k2", "text"), blocks.where("compare"), "byte", window, 1, False)
    hits = blocks.where("whole").select("k1", "k2", "at", "run").unionByName(_compared(windows).select("k1", "k2", "at", "run"))
    cuts = cut(compared, hits, "byte", window)
    return documents.join(cuts.drop("kept_text"), ["k1", "k2"], "left").select(
        F.col("doc_id").alias(id_col), F.col("n_units").alias("n_bytes"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_removed", "n_spans", "longest_span")),
        F.coalesce("kept_digest", "digest").alias("kept_sha256"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))
