"""SimHash near-duplicates by a self-join of the binary trie of the fingerprints.

Fingerprints are 64-bit majority votes over the XXH64 hashes of a text's word shingles. Two link if they differ in at most
``errors`` bits. The join walks the trie: from the pair (root, root) it steps to pairs of children, adds up the
bits in which the two paths differ, and leaves a pair as soon as that exceeds the budget.

* Equal fingerprints are one node of the graph, whatever their number.
* The upper levels of the walk are a Spark job: the trie is cut at ``prefix`` bits, and the blocks below two prefixes meet
  only if the prefixes themselves are within the budget. A prefix with more than ``BLOCK`` fingerprints is dealt out over
  several blocks by hash, so a crowd of near copies doesn't land in one task.
* The lower levels are walked inside a task, over sorted arrays, a bounded front of node pairs at a time. A task returns not
  its links but a spanning forest of them, so a crowd of n near copies costs n rows instead of n * n.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.components import components
from meetlake.llm.likeness import similar_links
from meetlake.llm.registry import query
from meetlake.llm.shared import as_long, row_key, staged, table, text_parts

SHINGLE = 4
ERRORS = 4
#: Fingerprints of a block on average at most, and node pairs of a step inside a task.
BLOCK = 1 << 14
FRONT = 1 << 18
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)  # of each byte value, the high bit first


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes. A text without a word has fingerprint 0."""
    words = text.lower().split()  # both for ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, size: end + 1 + size))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:] or ends[-1:])])
    count = len(hashes) // 8
    # how often each byte value stands at each of the eight places, then the bits of the values
    seen = np.frombuffer(hashes, np.uint8).astype(np.intp) + np.tile(np.arange(8) * 256, count)
    votes = np.bincount(seen, minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((votes * 2 > count).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(k1, k2, doc_id, fp) of every row, staged; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in text_parts(batch.column("text")):
                raw = data.tobytes()
                found += [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("k1", "k2", "doc_id")), pa.array(as_long(np.array(found, np.uint64)))],
                ["k1", "k2", "doc_id", "fp"])

    rows = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, fp bigint"), "fingerprints")


class Trie:
    """The binary trie of sorted 64-bit values, level by level: of each node its two children and its leaves."""

    def __init__(self, values: np.ndarray):
        self.values, self.first, self.children = values, [np.zeros(1, np.int32)], []
        step = values[1:] ^ values[:-1] if len(values) else values
        for depth in range(64):
            if len(self.first[-1]) == len(values):
                break
            upper = self.first[-1]
            lower = np.flatnonzero(np.concatenate(([True], step >> np.uint64(63 - depth) > 0))).astype(np.int32)
            bit = (values[lower] >> np.uint64(63 - depth)) & np.uint64(1)
            below = np.full((2, len(upper)), -1, np.int32)
            below[bit.astype(np.int8), np.searchsorted(upper, lower, "right") - 1] = np.arange(len(lower))
            self.children.append(below)
            self.first.append(lower)
        self.sizes = [np.diff(np.append(f, len(values))).astype(np.int32) for f in self.first]

    def at(self, depth: int) -> int:
        """Levels end where every node is one leaf; deeper ones are that last level again."""
        return min(depth, len(self.children))

    def child(self, depth: int, side: int, nodes: np.ndarray) -> np.ndarray:
        if depth < len(self.children):
            return self.children[depth][side][nodes]
        leaf = self.values[nodes] >> np.uint64(63 - depth) & np.uint64(1)
        return np.where(leaf == side, nodes, -1)


def linked(left: Trie, right: Trie, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of leaves, one of each trie, that differ in at most ``errors`` bits; of one trie each pair once."""
    same = left is right
    stack = [(0, np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int8))]
    while stack:
        depth, u, v, differ = stack.pop()
        if len(u) > FRONT:
            half = len(u) // 2
            stack += [(depth, u[:half], v[:half], differ[:half]), (depth, u[half:], v[half:], differ[half:])]
            continue
        a, b = left.at(depth), right.at(depth)
        n, m = left.sizes[a][u], right.sizes[b][v]
        few = n * m <= 4 if depth < 64 else np.ones(len(u), bool)
        if few.any():  # so few leaves are compared at once
            x, y = u[few], v[few]
            n, m = n[few], m[few]
            pairs = n * m
            at = np.repeat(np.arange(len(x)), pairs)
            turn = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            i = left.first[a][x][at] + turn // m[at]
            j = right.first[b][y][at] + turn % m[at]
            near = np.bitwise_count(left.values[i] ^ right.values[j]) <= errors
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            u, v, differ = u[~few], v[~few], differ[~few]
        if not len(u):
            continue
        grown = []
        for s in (0, 1):
            x = left.child(depth, s, u)
            for t in (0, 1):
                y = right.child(depth, t, v)
                alive = (x >= 0) & (y >= 0)
                if s != t:
                    alive &= differ < errors
                    if same and s:
                        alive &= u != v
                if alive.any():
                    grown.append((x[alive], y[alive], differ[alive] + np.int8(s != t)))
        if grown:
            stack.append((depth + 1, *(np.concatenate(c) for c in zip(*grown))))


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """For each of n places the least place it is linked with, over any number of links."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            apart = low != high
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(label, high[apart], low[apart])
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _forests(errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one = np.sort(np.array(row["fps_a"], np.int64).view(np.uint64))
                same = (row["a"], row["sa"]) == (row["b"], row["sb"])
                two = one if same else np.sort(np.array(row["fps_b"], np.int64).view(np.uint64))
                tries = [Trie(one)]
                tries.append(tries[0] if same else Trie(two))
                values = one if same else np.concatenate((one, two))
                shift = 0 if same else len(one)
                label = forest(((i, j + shift) for i, j in linked(*tries, errors)), len(values))
                to = np.flatnonzero(label != np.arange(len(values)))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(values[to])), pa.array(as_long(values[label[to]]))],
                                                 ["a", "b"])
    return run


def trie_links(nodes: DataFrame, errors: int = ERRORS) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints (column fp) into the same components as all links would."""
    spark = nodes.sparkSession
    total = nodes.count()
    bits = min(16, max(4, (total // BLOCK).bit_length()))
    nodes = nodes.select("fp", F.shiftrightunsigned("fp", 64 - bits).cast("int").alias("p"))
    # one row a prefix, 2 ** 16 at most: the bound of what may be broadcast
    sizes = nodes.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    dealt = nodes.join(F.broadcast(sizes), "p").withColumn("s", F.pmod(F.xxhash64("fp"), "k").cast("int"))
    blocks = staged(dealt.groupBy("p", "s").agg(F.collect_list("fp").alias("fps")), "blocks")
    near = [m for m in range(1 << bits) if m.bit_count() <= errors]
    if len(near) == 1 << bits:
        masks = F.expr(f"sequence(0, {(1 << bits) - 1})")
    else:
        masks = F.expr(f"filter(sequence(0, {(1 << bits) - 1}), m -> bit_count(m) <= {errors})")
    pairs = (blocks.select(F.col("p").alias("a"), F.col("s").alias("sa"), F.explode(masks).alias("mask"))
             .withColumn("b", F.col("a").bitwiseXOR(F.col("mask"))).where("a <= b")
             .join(F.broadcast(sizes.select(F.col("p").alias("b"), "k")), "b")
             .select("a", "sa", "b", F.explode(F.expr("sequence(0, k - 1)")).alias("sb"))
             .where("a < b or sa <= sb"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 2 // BLOCK))
    met = (pairs.join(blocks.select(F.col("p").alias("a"), F.col("s").alias("sa"), F.col("fps").alias("fps_a")), ["a", "sa"])
           .join(blocks.select(F.col("p").alias("b"), F.col("s").alias("sb"), F.col("fps").alias("fps_b")), ["b", "sb"])
           .repartition(parts, "a", "sa", "b", "sb"))
    return met.mapInArrow(_forests(errors), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    errors: int = ERRORS, percent: int | None = None) -> DataFrame:
    """Per row: k1, k2 (its key), doc_id, fp and root (the component's least fingerprint; signed longs), component_id (the
    least doc_id that it reaches), n_linked.

    n_linked counts the rows of the component. Null and empty texts have fingerprint 0 and link like any other. Null ids
    don't count for component_id; it is null if a component has no other. Repeated rows link with each other. With
    ``percent``, texts whose five-word shingles have that Jaccard similarity or more link as well, whatever their
    fingerprints. Other columns are not looked at.
    """
    found = fingerprints(docs, id_col, text_col, shingle)
    nodes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    links = trie_links(nodes.select("fp"), errors)
    if percent is not None:
        links = links.unionByName(similar_links(docs, found, percent, id_col, text_col))
    roots = components(links)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_linked"))
    return found.join(rooted.select("fp", "root").join(groups, "root"), "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                errors: int = ERRORS, percent: int | None = None) -> DataFrame:
    """The documents with one row left of each component: that with the least id, of equal ids that with the least key.

    Of rows that repeat both id and text one stays.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, errors, percent)
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "k1", "k2")
    first = found.groupBy("root").agg(F.min(order).alias("o")).select("o.k1", "o.k2")
    one, two = (c.alias(f"__{k}") for c, k in zip(row_key(docs[id_col], docs[text_col]), ("k1", "k2"), strict=True))
    kept = docs.select("*", one, two).join(first.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")),
                                           ["__k1", "__k2"])
    return kept.dropDuplicates(["__k1", "__k2"]).select(*(F.col(f"`{c}`") for c in docs.columns))


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_linked")
