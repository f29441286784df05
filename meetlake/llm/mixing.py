"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells (source, language, topic) of tokens. Each sweep scales the cells so that their sums meet the
targets of the sources, then of the languages, then of the topics; the cells' ratios of fitted to present tokens are
the documents' weights. Documents are then drawn one by one with the weight, scaled to the wanted number of tokens, as
probability: Poisson sampling by a hash of the row, so that a draw depends on nothing but the row and the seed.

Cells are aggregated before the shuffle, so a source with a third of all documents is a few rows a task. Sweeps work on the
table of cells alone. Nothing but sums of all cells reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.shared import discard, mixed, row_key, staged, table, text_parts, word_hashes, words_of

TOPICS, SWEEPS, TOLERANCE = 8, 200, 1e-5
#: A sweep that leaves more than this part of the gap ends the fit: the targets can't all be met.
STALLED = 0.999
#: Sources and topics move towards equal shares by this power of their present shares; languages keep theirs.
TEMPER = {"source": 0.5, "lang": 1.0, "topic": 0.5}
#: Expected tokens drawn, as a share of those present.
BUDGET = 0.5
MISSING = "(none)"

Targets = Mapping[str, float | Mapping[str, float]]


def profiled(docs: DataFrame, id_col: str, text_col: str, keys: tuple[str, ...]) -> DataFrame:
    """k1, k2, doc_id, the keys, n_tokens (words) and topic of every row, staged.

    A topic is one of TOPICS classes of words (by hash); a text's is the one that most of its words of four and more bytes are
    of, the smallest of equals, and null without such words.
    """
    schema = "k1 bigint, k2 bigint, doc_id bigint, " + "".join(f"{k} string, " for k in keys) + "n_tokens bigint, topic string"
    names = ["k1", "k2", "doc_id", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_parts(batch.column("text")):
                starts, ends, bounds = words_of(data, offsets)
                long = ends - starts >= 4
                of = mixed(word_hashes(data, starts, ends)) >> np.uint64(61)
                text = np.repeat(np.arange(high - low), np.diff(bounds))
                votes = np.bincount((text * TOPICS + of.astype(np.int64))[long], minlength=(high - low) * TOPICS)
                votes = votes.reshape(-1, TOPICS)
                topic = np.where(votes.any(axis=1), votes.argmax(axis=1), -1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(low, high - low) for n in names), pa.array(np.diff(bounds), pa.int64()),
                     pa.array([f"topic{t}" if t >= 0 else None for t in topic], pa.string())], [*names, "n_tokens", "topic"])

    rows = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).cast("bigint").alias("doc_id"),
                       *(F.col(k).cast("string").alias(k) for k in keys), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(run, schema), "profiles")


def target_shares(cells: DataFrame, margin: str, target: float | Mapping[str, float]) -> DataFrame:
    """(margin, target) of one margin: given shares, or the present shares to a power; both are scaled to add up to 1.

    Categories that a given mapping leaves out get 0. Given ones that have no tokens cannot be met and are left out.
    """
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("share"))
    if isinstance(target, Mapping):
        wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items()], f"{margin} string, given double")
        sums = sums.join(wanted, margin, "left").select(margin, F.coalesce("given", F.lit(0.0)).alias("share"))
    else:
        sums = sums.select(margin, F.when(F.col("share") > 0, F.pow("share", target)).otherwise(0.0).alias("share"))
    total = sums.agg(F.sum("share")).first()[0] or 1.0
    return sums.select(margin, (F.col("share") / F.lit(float(total))).alias("target"))


def raked(cells: DataFrame, targets: Targets, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """The cells (margins, tokens) with ``fitted``, shares whose margins meet the targets, and ``margin_gap``, by how much one is
    off at most.

    A sweep ends with exact sums for the last margin; the fit ends when no other margin is off by more than the tolerance. Cells
    without tokens stay at 0, so targets that need them can't be met: then the gap stops falling, and the fit ends with that gap.
    One that goes on falling after so many sweeps fails.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("fitted", F.col("tokens") / F.lit(float(max(total, 1))))
    aims = {m: staged(target_shares(cells, m, t), "targets") for m, t in targets.items()}
    every = [a.select(F.lit(m).alias("margin"), F.col(m).alias("category"), "target") for m, a in aims.items()]
    wanted = every[0]
    for one in every[1:]:
        wanted = wanted.unionByName(one)
    wanted = staged(wanted, "targets")
    last, written = float("inf"), None
    for _ in range(sweeps):
        for margin, aim in aims.items():
            sums = now.groupBy(margin).agg(F.sum("fitted").alias("sum"))
            scale = sums.join(aim, margin).select(margin, F.when(F.col("sum") > 0, F.col("target") / F.col("sum"))
                                                  .otherwise(0.0).alias("scale"))
            # written margin by margin, as each reads the cells twice: the plan would double with every margin
            now = staged(now.join(scale, margin).withColumn("fitted", F.col("fitted") * F.col("scale")).drop("scale"), "cells")
            if written is not None:
                discard(written)
            written = now
        sums = now.select(F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(m).alias("category")) for m in aims))).alias("of"),
                          "fitted").groupBy("of.margin", "of.category").agg(F.sum("fitted").alias("sum"))
        gap = sums.join(wanted, ["margin", "category"]).agg(F.max(F.abs(F.col("sum") - F.col("target")))).first()[0] or 0.0
        if gap <= tolerance or gap >= STALLED * last:
            return now.withColumn("margin_gap", F.lit(gap))
        last = gap
    raise RuntimeError(f"margins are still off by {last} after {sweeps} sweeps")


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """The cells with ``probability``: fitted over present tokens, times the factor that makes the expected tokens the budget.

    Probabilities end at 1; the factor is raised for the others until the whole budget is met or all documents are taken. Each
    round but the last takes another cell whole, so the rounds end.
    """
    present = cells.agg(F.sum("tokens")).first()[0] or 0
    ratio = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(0.0)
    cells, factor = cells.withColumn("ratio", ratio), budget * present
    while True:
        full = F.col("ratio") * factor >= 1
        taken, rest = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)),
                                F.sum(F.when(full, 0.0).otherwise(F.col("fitted")))).first()
        if not rest or (better := (budget * present - taken) / rest) <= factor * (1 + 1e-12):
            break
        factor = better
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * float(factor))).drop("ratio")


def _draw(seed: int) -> Column:
    """A number from 0 to 1 that depends on the row's key and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k1", "k2"), 11) / F.lit(float(1 << 53))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
            targets: Targets | None = None, budget: float = BUDGET, seed: int = 7) -> DataFrame:
    """Per row: k1, k2 (its key), doc_id, source, lang, topic, n_tokens, weight, probability, sampled, and margin_gap, by how
    much the fit misses a margin at most.

    Null categories are a category of their own, named "(none)". Texts without words weigh nothing and are never drawn.
    Repeated rows are drawn or left together. An empty table gives an empty result. Other columns are not looked at.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(source_col).alias("source"),
                        F.col(lang_col).alias("lang"))
    rows = profiled(named, "id", "body", ("source", "lang"))
    margins = ("source", "lang", "topic")
    rows = rows.withColumns({m: F.coalesce(m, F.lit(MISSING)) for m in margins})
    cells = staged(rows.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")), "cells")
    fitted = calibrated(raked(cells, targets or TEMPER), budget)
    weighed = rows.join(fitted.select(*margins, "probability", "margin_gap", (F.col("fitted") / F.greatest("tokens", F.lit(1))).alias("weight")),
                        [*margins])
    return weighed.select("k1", "k2", "doc_id", *margins, "n_tokens", "weight", "probability",
                          ((F.col("n_tokens") > 0) & (_draw(seed) < F.col("probability"))).alias("sampled"), "margin_gap")


def sampled_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents drawn, unchanged."""
    drawn = mixture(docs, id_col, text_col, **options).where("sampled").select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    one, two = (c.alias(f"__{k}") for c, k in zip(row_key(docs[id_col], docs[text_col]), ("k1", "k2"), strict=True))
    return docs.select("*", one, two).join(drawn, ["__k1", "__k2"], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


@query("op7_source_mixing")
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("k1", "k2")
