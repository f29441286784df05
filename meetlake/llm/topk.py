"""Exact top-k by integer inner product: exhaustive term-at-a-time accumulation, partition selection and merge.

Candidates are dealt into blocks of about ``CANDIDATES`` rows, queries into blocks of about ``QUERIES``. A candidate block
holds an inverted index: for every term (vector component) the rows in which it isn't 0 and its values there. A block of
queries walks its terms one at a time and scatters weight times postings into a dense array of scores; each block of
candidates then gives its k best, and these are merged by query.

A candidate block and the query blocks that ask it meet in one stream: the block comes first and its index is kept while
the queries pass by. So a block is shuffled once, or, where there are fewer blocks than tasks, once for each of the tasks that
share its queries. Neither side is broadcast or collected, and nothing is joined.

Rows that repeat an id and vector are one entry with a count; a vector is asked once, however often its row repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.shared import staged, table

CANDIDATES, QUERIES, K = 4096, 128, 20


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; vectors null or with a null or non-finite component are left out."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint"))
    return df.where(x.isNotNull() & ~bad & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"),
                                                                            whole.alias("v"))


def _matrix(ids: list, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components by term; a vector that is shorter than others has 0 in the terms that it lacks."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((width, len(vectors)), np.int64)
    for k, v in enumerate(vectors):
        out[:len(v), k] = v
    return np.array(ids, np.int64), out


class Postings:
    """The inverted index of a block: per term, the rows that have it and their values."""

    def __init__(self, ids: list, vectors: list, counts: list):
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        self.ids, terms = _matrix([ids[i] for i in order], [vectors[i] for i in order])
        self.counts = np.array(counts, np.int64)[order]
        self.largest = float(np.abs(terms.astype(np.float64)).max(initial=0))
        self.terms = []
        for values in terms:
            rows = np.flatnonzero(values)
            # a term that nearly all rows have is a list of all rows
            self.terms.append((slice(None), values) if 2 * len(rows) > len(values) else (rows, values[rows]))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Scores (query, row) of query vectors given by term. In 32 bits where no sum can leave them, else in 64."""
        bound = self.largest * float(np.abs(weights.astype(np.float64)).max(initial=0)) * len(weights)
        kind = np.int32 if bound < 2**31 else np.int64
        total = np.zeros((weights.shape[1], len(self.ids)), kind)
        step = np.empty(len(self.ids), kind)
        for weight, (rows, values) in zip(weights.astype(kind), self.terms):
            values = values.astype(kind)
            for q in np.flatnonzero(weight):
                if isinstance(rows, slice):
                    np.multiply(values, weight[q], out=step)
                    total[q] += step
                else:
                    total[q, rows] += values * weight[q]
        return total


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k highest of one query's, ties to smaller ids (ids ascend); the query's own id is left out."""
    at = np.flatnonzero(ids != own)
    s = scores[at]
    if len(s) > k:
        limit = np.partition(s, len(s) - k)[len(s) - k]
        above, ties = np.flatnonzero(s > limit), np.flatnonzero(s == limit)
        take = np.concatenate((above, ties[:k - len(above)]))
        at, s = at[take], s[take]
    return at, s


def _search(k: int):
    """Of a stream of blocks (block, part, turn, ids, vectors, extra) the k best entries of every query of each part.

    Turn -1 is the candidate block, extra its entries' counts; other turns are blocks of queries, extra their numbers.
    """
    names = ["query_id", "query", "vec_id", "n", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for row in range(len(batch)):
                ids, vectors, extra = (batch.column(c)[row].as_py() for c in ("ids", "vectors", "extra"))
                if batch.column("turn")[row].as_py() < 0:
                    index = Postings(ids, vectors, extra)
                    continue
                ids, weights = _matrix(ids, vectors)
                scores = index.scores(weights[:len(index.terms)])
                found = [best(scores[q], index.ids, own, k) for q, own in enumerate(ids)]
                size = [len(f[0]) for f in found]
                at = np.concatenate([f[0] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, size)), pa.array(np.repeat(np.array(extra, np.int64), size)), pa.array(index.ids[at]),
                     pa.array(index.counts[at]), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))], names)
    return run


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0,
          k: int = K, repeats: bool = False) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of every query's k highest inner products with the other rows.

    Ties go to smaller ids; a query with fewer other rows gets all of them. Vectors null or with null or non-finite components
    and rows without an id take no part, neither as queries nor as candidates. Components beyond 64-bit integers are
    clipped to them. Of rows that repeat an id and vector one takes part as candidate, with ``repeats`` all; as a query such a
    row is asked once. An id with several vectors asks with each, so its ranks come once a vector. Vectors of unequal length
    are compared in the components that both have. Other columns are not looked at.
    """
    spark = df.sparkSession
    entry = integer_vectors(df, id_col, vector_col, scale).groupBy("vec_id", "v").agg(
        (F.count(F.lit(1)) if repeats else F.lit(1).cast("bigint")).alias("n"))
    entries = staged(entry.withColumn("query", F.xxhash64("vec_id", "v")), "vectors")
    asked = entries.where(is_query(F.col("vec_id")))
    n_blocks = max(1, -(-entries.count() // CANDIDATES))
    n_turns = max(1, -(-asked.count() // QUERIES))
    # where there are fewer blocks than tasks, so many tasks share the queries of a block
    parts = min(n_turns, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks))

    def packed(rows: DataFrame, number: Column, count: int, name: str, extra: str) -> DataFrame:
        row = F.struct("vec_id", "v", F.col(extra).cast("bigint").alias("x"))
        return rows.groupBy(F.pmod(number, F.lit(count)).cast("int").alias(name)).agg(F.collect_list(row).alias("r"))

    # dealt by a hash of id and vector: the same blocks whenever a task is run again
    blocks = packed(entries, F.col("query"), n_blocks, "block", "n").select("block", F.explode(F.sequence(
        F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).alias("turn"), "r")
    turns = packed(asked, F.xxhash64("query"), n_turns, "turn", "query").select(F.explode(F.sequence(
        F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod("turn", F.lit(parts)).alias("part"), "turn", "r")
    met = blocks.unionByName(turns).repartition("block", "part").sortWithinPartitions("block", "part", "turn").select(
        "turn", F.col("r.vec_id").alias("ids"), F.col("r.v").alias("vectors"), F.col("r.x").alias("extra"))
    found = met.mapInArrow(_search(k), "query_id bigint, query bigint, vec_id bigint, n bigint, score bigint")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    # k entries a query are enough; each is then as many rows as it has copies, k at most
    few = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rows = few.select("query_id", "query", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("n", F.lit(k)))).alias("copy"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0),
s AS (
    SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM q JOIN v c ON q.vec_id <> c.vec_id
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op4_topk_search", _SQL)
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, repeats=True)
