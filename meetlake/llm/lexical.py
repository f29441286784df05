"""Ranked lexical search with bag deduplication: every item's best documents by integer term weights.

Documents are restricted to the items' vocabulary: what is left is a sparse vector of term counts and the length factor m.
Documents that agree in both score alike for every item, so

* they form one class: found by a hash of vector and m, and verified by comparing the vectors themselves;
* classes are scored once, term at a time, into dense arrays of items, and each task keeps the best classes of every item;
* a chosen class is expanded to its members by ascending id.

Of the classes in order of score and least member, the k best documents lie in the first k: each of those gives at least one
document that comes before all documents of later classes. So k classes an item are enough, whatever their sizes.

The items are a stated query set. They are taken in blocks whose vocabulary has a checked size, and each block reads all
documents; a block's vocabulary, weights and chosen classes are what is sent to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.shared import CHUNK, Rolling, as_long, discard, list_array, runs_of, staged, table

K = 50
#: Items of a block at most, and the bytes of its terms (a single item may have more).
ITEMS, VOCABULARY = 512, 1 << 23
#: Class and item pairs that are scored at a time.
CELLS = 1 << 19
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_LAST = 2**63 - 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, A-Z in lower case, and each text's start among them (with an end); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return _LOWER[data], offsets - offsets[0]


def term_pieces(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms piece by piece: the first byte of a piece, its bytes, and start and end of its terms in it.

    Pieces are cut between terms, so a long text lies in many and no array is larger than a piece.
    """
    low = 0
    while low < len(data):
        high = min(low + size, len(data))
        while high < len(data) and _TERM[data[high]]:
            ahead = _TERM[data[high:high + size]]
            high += len(ahead) if ahead.all() else int(np.argmin(ahead))
        piece = data[low:high]
        inside = offsets[np.searchsorted(offsets, low):np.searchsorted(offsets, high, "right")] - low
        starts, ends, _ = runs_of(_TERM[piece], inside)
        yield low, piece, starts, ends
        low = high


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of every item. Rows of one id are one item; rows without an id take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_numpy()
            data, offsets = flat(batch.column("text"))
            for low, piece, starts, ends in term_pieces(data, offsets):
                raw = piece.tobytes()
                at = ids[np.searchsorted(offsets, low + starts, "right") - 1]
                found = sorted({(i, raw[a:b]) for i, a, b in zip(at.tolist(), starts.tolist(), ends.tolist())})
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()),
                                                  pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])

    rows = items.select(F.col(f"`{id_col}`").cast("bigint").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.where("item_id IS NOT NULL").mapInArrow(run, "item_id bigint, term binary").distinct()


class Vocabulary:
    """Sorted terms, found by hash and compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
        self.starts = np.concatenate((np.zeros(1, np.int64), self.ends[:-1]))
        hashes = Rolling.over_bytes(self.data).spans(self.starts, self.ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of the items share a hash")

    def places(self, piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms [start, end) of a piece are in the vocabulary, and their numbers in it."""
        if not len(starts) or not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wanted = Rolling.over_bytes(piece).spans(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == wanted)
        number = self.order[at[hit]]
        size = ends[hit] - starts[hit]
        alike = size == self.ends[number] - self.starts[number]
        hit, number, size = hit[alike], number[alike], size[alike]
        if not len(hit):
            return hit, number
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        same = piece[np.repeat(starts[hit], size) + step] == self.data[np.repeat(self.starts[number], size) + step]
        equal = np.logical_and.reduceat(same, first)
        return hit[equal], number[equal]


def bags(docs: DataFrame, words: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: its term count, and the vocabulary's terms in it with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        width = max(len(words.terms), 1)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            n = np.zeros(len(batch), np.int64)
            keys, counts = [], []
            for low, piece, starts, ends in term_pieces(data, offsets):
                row = np.searchsorted(offsets, low + starts, "right") - 1
                n += np.bincount(row, minlength=len(batch))
                hit, number = words.places(piece, starts, ends)
                key, count = np.unique(row[hit] * width + number, return_counts=True)
                keys.append(key)
                counts.append(count)
            # a row that lies in many pieces adds up
            key, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, inverse, np.concatenate([np.zeros(0, np.int64), *counts]))
            ends = np.searchsorted(key, (np.arange(len(batch)) + 1) * width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), list_array((key % width).astype(np.int32), ends, pa.int32()),
                 list_array(total, ends, pa.int64())], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return staged(rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"), "bags")


def classed(found: DataFrame, n_docs: int, n_terms: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, class, terms, tfs, m) that have a term of the vocabulary, and their classes with size and least id.

    A class is named by a hash of its vector and m. Rows are grouped by the vector and m themselves; if two groups share a name,
    all are named anew by another hash, so a name stands for one vector.
    """
    length = F.expr(f"50 + CAST(CAST(50 AS DECIMAL(2, 0)) * CAST(n AS DECIMAL(18, 0)) * {n_docs}BD DIV {n_terms}BD AS BIGINT)")
    rows = found.where(F.size("terms") > 0).withColumn("m", length)
    seed = 0
    while True:
        named = rows.withColumn("class", F.xxhash64(F.lit(seed), "terms", "tfs", "m"))
        classes = staged(named.groupBy("class", "terms", "tfs", "m").agg(
            F.count(F.lit(1)).alias("members"), F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("least")), "classes")
        if classes.groupBy("class").count().where("count > 1").isEmpty():
            return named, classes
        discard(classes)
        seed += 1


class Best:
    """The k best classes of every item among those offered, by score and least member."""

    def __init__(self, items: int, k: int):
        self.k, self.limit = k, np.ones(items, np.int64)
        self.held = [np.zeros(0, np.int64)] * 4
        self.waiting: list[tuple] = []

    def offer(self, scores: np.ndarray, names: np.ndarray, least: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.limit)
        self.waiting.append((item, scores[row, item], least[row], names[row]))
        if sum(len(w[0]) for w in self.waiting) > 1 << 18:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        item, score, least, name = (np.concatenate(c) for c in zip(self.held, *self.waiting))
        order = np.lexsort((name, least, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.k]
        last = item[place == self.k - 1], score[order][place[place < self.k] == self.k - 1]
        self.limit[last[0]] = last[1]
        self.held = [c[order] for c in (np.concatenate(c) for c in zip(self.held, *self.waiting))]
        self.waiting = []
        return self.held


def scored(classes: DataFrame, weights: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int, k: int) -> DataFrame:
    """(item, class, score, least) of each task's k best classes of every item with a score above 0.

    Term t weighs ``weights[t]`` and occurs in the items ``items[first[t]:first[t + 1]]``.
    """
    sent = classes.sparkSession.sparkContext.broadcast((weights, first, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, first, items = sent.value
        best, held = Best(n_items, k), max(1, CELLS // max(n_items, 1))
        for whole in batches:
            for start in range(0, len(whole), held):
                batch = whole.slice(start, held)
                terms = batch.column("terms").flatten().to_numpy()
                tfs = batch.column("tfs").flatten().to_numpy()
                size = pc.list_value_length(batch.column("terms")).to_numpy()
                row = np.repeat(np.arange(len(batch)), size)
                m = batch.column("m").to_numpy()[row]
                value = weights[terms] * ((10**9 * tfs) // (1000 * tfs + 20 * m))
                total = np.zeros((len(batch), n_items), np.int64)
                order = np.argsort(terms, kind="stable")
                bounds = np.flatnonzero(np.diff(terms[order], prepend=-1))
                for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)]):
                    term, at = terms[order[a]], order[a:b]
                    # a row has a term once, so no cell is met twice
                    total[row[at][:, None], items[first[term]:first[term + 1]]] += value[at][:, None]
                best.offer(total, batch.column("class").to_numpy(), batch.column("least").to_numpy())
        item, score, least, name = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(name), pa.array(score), pa.array(least)],
                                         ["item", "class", "score", "least"])

    return classes.select("class", "terms", "tfs", "m", "least").mapInArrow(
        run, "item bigint, class bigint, score bigint, least bigint")


def _blocks(asked: DataFrame) -> list[DataFrame]:
    """The items' terms in blocks of a checked number of items and bytes of terms."""
    sizes = staged(asked.groupBy("item_id").agg(F.sum(F.length("term")).alias("bytes")), "item-sizes")
    whole = sizes.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-whole["items"] // ITEMS), -(-whole["bytes"] // VOCABULARY))
    while blocks > 1:
        dealt = sizes.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("b")).agg(
            F.count(F.lit(1)).alias("items"), F.sum("bytes").alias("bytes"))
        if dealt.where(f"items > 1 AND (items > {2 * ITEMS} OR bytes > {2 * VOCABULARY})").isEmpty():
            break
        blocks *= 2
    discard(sizes)
    return [asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank from 1, doc_id, score) of every item's k best documents with a score above 0.

    Equal scores go by ascending doc_id, rows without an id last; ids are below 2 ** 63 - 1. Every row is a document, also one that
    repeats another. Null and empty texts have no terms: such documents are never found and don't count, such items find
    nothing. Rows of one item id are one item with the terms of all; items without an id take no part. Empty tables give no rows.
    Long texts are read in pieces. Other columns are not looked at.
    """
    spark = docs.sparkSession
    asked = staged(item_terms(items, item_col, item_text_col), "item-terms")
    out = None
    for block in _blocks(asked):
        found = _searched(docs, block, k, id_col, text_col)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out


def _searched(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    pairs = asked.collect()  # one block of the query set, of checked size
    if not pairs:
        return None
    ids = np.unique(np.array([r["item_id"] for r in pairs], np.int64))
    words = Vocabulary(sorted({bytes(r["term"]) for r in pairs}))
    number = {t: n for n, t in enumerate(words.terms)}
    by_term = sorted((number[bytes(r["term"])], int(np.searchsorted(ids, r["item_id"]))) for r in pairs)
    first = np.searchsorted([t for t, _ in by_term], np.arange(len(words.terms) + 1))
    items = np.array([i for _, i in by_term], np.int64)

    held = bags(docs, words, id_col, text_col)
    counts = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = counts["docs"], counts["terms"] or 0
    if not n_docs:
        return None
    named, classes = classed(held, n_docs, n_terms)
    df = np.zeros(len(words.terms), np.int64)
    for r in classes.select(F.explode("terms").alias("t"), "members").groupBy("t").agg(F.sum("members").alias("df")).collect():
        df[r["t"]] = r["df"]  # as many rows as the vocabulary has terms at most
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    part = scored(classes, weights, first, items, len(ids), k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "least", "class")
    chosen = staged(part.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("item", "class", "score"),
                    "chosen-classes")
    # k classes an item at most, and a block has 2 * ITEMS items
    wanted = F.broadcast(chosen.select("class").distinct())
    inside = Window.partitionBy("class").orderBy(F.col("doc_id").asc_nulls_last())
    members = named.select("class", "doc_id").join(wanted, "class", "left_semi").withColumn(
        "place", F.row_number().over(inside)).where(F.col("place") <= k).select("class", "doc_id")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    names = F.array([F.lit(int(i)) for i in ids])
    result = staged(chosen.join(members, "class").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.get(names, F.col("item").cast("int")).cast("bigint").alias("item_id"), "rank", "doc_id", "score"), "ranked")
    for stage in (held, classes, chosen):
        discard(stage)
    return result


_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
size AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
m AS MATERIALIZED (SELECT r, doc_id, 50 + ((50 * len(ts) * n_docs) // n_terms) AS m FROM d, size WHERE len(ts) > 0),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term, n_docs),
s AS (SELECT q.item_id, m.doc_id, m.r, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY q.item_id, m.doc_id, m.r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


@query("op13_ranked_search", _SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
