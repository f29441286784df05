"""Substring deduplication by level-wise doubling of repeated word windows.

A word goes if a window of ``window`` consecutive words that covers it also starts anywhere else, in another document or
in the same one. The lengths double from ``seed`` words up to the window's length: spans that repeat at one length alone
are extended to twice that length, until the window's length is reached or no candidate survives.

1. ``seed`` words: one span for each window, chosen by content (see ``seeds``), counted over all documents.
2. Twice that: of the spans left, those that repeat when extended to the right or to the left. Each window holds one of
   the two, so no window is lost.
3. The window: the windows of a stretch that occurs twice all repeat; where the spans left lie in different stretches, their
   windows are counted one by one.

Counts are added up before each shuffle, so a passage in a third of all documents is a small row there. The joins that
follow have few columns and large keys split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.seeds import block_rows, compare_blocks, cut, facts, keyed_texts, scan, seed_rows
from meetlake.llm.shared import discard, row_key, staged, table

WINDOW = 35
SEED = 9


def _doubled(scanned: DataFrame) -> DataFrame:
    """The seeds that repeat at their own length and at twice that. The scan is discarded."""
    seeds = seed_rows(scanned)
    twice = F.count(F.lit(1)) > 1
    repeated = seeds.groupBy("lead").agg(twice.alias("again")).where("again").select("lead")
    first = staged(seeds.join(repeated, "lead"), "word-level")
    discard(scanned)
    # a document can hold a span both as left and as right extension: counted twice, it is only kept for the next level
    longer = (first.select(F.explode(F.array("left", "right")).alias("span")).where("span <> 0")
              .groupBy("span").agg(twice.alias("again")).where("again").select("span"))
    second = staged(
        first.join(longer.withColumnRenamed("span", "left").withColumn("l", F.lit(True)), "left", "left")
        .join(longer.withColumnRenamed("span", "right").withColumn("r", F.lit(True)), "right", "left")
        .where("l or r").select("k1", "k2", "lead", "context", "at", "run", "back"), "word-level")
    discard(first)
    return second


def _live_seeds(second: DataFrame) -> DataFrame:
    """Whose windows repeat whole, and which are yet to compare."""
    contexts = second.groupBy("lead", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"))
    several = contexts.groupBy("lead").agg(F.count(F.lit(1)).alias("contexts"))
    compare = (F.col("contexts") > 1) & ((F.col("n") == 1) | (F.col("one") == F.struct("k1", "k2", "at")))
    return (second.join(contexts.join(several, "lead"), ["lead", "context"])
            .select("k1", "k2", "at", "run", "back", (F.col("n") > 1).alias("whole"), compare.alias("compare"))
            .where("whole or compare"))


def _cut_texts(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int) -> tuple[DataFrame, DataFrame]:
    if not 1 <= seed <= window // 3:
        raise ValueError("a seed must be at most a third of the window")
    scanned = scan(docs, id_col, text_col, "word", window, seed, doubled=True)
    documents = facts(scanned)
    second = _doubled(scanned)
    compared = compare_blocks(keyed_texts(docs, id_col, text_col), _live_seeds(second), "word", window, 1)
    discard(second)
    rows = block_rows(compared).drop("hull")  # of single windows core and hull are the window
    again = rows.groupBy("first", "core").agg((F.count(F.lit(1)) > 1).alias("again")).where("again").drop("again")
    hits = rows.join(again, ["first", "core"]).select("k1", "k2", "at", "run")
    return documents, cut(compared, hits, "word", window)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, n_spans, longest_span (words), kept_sha256 (kept words, one space between).

    Null and empty texts have no words; texts shorter than the window lose none. Repeated rows are documents of their
    own, so each is the other's copy. Rows with null ids are returned with a null id. Other columns are not looked at.
    """
    documents, cuts = _cut_texts(docs, id_col, text_col, window, seed)
    return documents.join(cuts.drop("kept_text"), ["k1", "k2"], "left").select(
        F.col("doc_id").alias(id_col), F.col("n_units").alias("n_words"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_removed", "n_spans", "longest_span")),
        F.coalesce("kept_digest", "digest").alias("kept_sha256"))


def without_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                           seed: int = SEED) -> DataFrame:
    """The documents with repeated windows cut out; texts that lose nothing stay as they are, all other columns too."""
    _, cuts = _cut_texts(docs, id_col, text_col, window, seed)
    one, two = (c.alias(f"__{k}") for c, k in zip(row_key(docs[id_col], docs[text_col]), ("k1", "k2"), strict=True))
    cuts = cuts.where("n_removed > 0").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"),
                                              F.col("kept_text").alias("__kept"))
    joined = docs.select("*", one, two).join(cuts, ["__k1", "__k2"], "left")
    return joined.select(*(F.coalesce("__kept", F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`")
                           for c in docs.columns))


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))
