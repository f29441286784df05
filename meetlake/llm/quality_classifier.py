"""Document quality: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text's features are the n-grams of its words and of their shapes (runs of capitals, other letters and digits become one
character each, so ``shout!!`` and ``noise!!`` agree), hashed into 2 ** BITS places. A family's n-grams weigh one in all,
so long texts don't outweigh short ones. Scores are sparse dot products of these weights with the model's.

The model is trained in one task on about SAMPLE labelled rows at most, those with a small hash of their id, so the
choice doesn't depend on partitions. The bound is a documented parameter, not a property of the data: training is
sequential by nature, and the weights (one megabyte whatever the corpus) are broadcast to score all texts in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.shared import Rolling, _BYTE_VALUE, _BYTES, bounded, mixed, table, text_parts, word_hashes, words_of

BITS, SAMPLE, THRESHOLD = 18, 8_000, 0.3
ORDERS = (1, 2)
#: FTRL-proximal: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
#: Weight of each family of n-grams in all.
FAMILY = 4.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("a"):ord("z") + 1] = _SHAPE[128:] = ord("a")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    shape = _SHAPE[data]
    keep = np.concatenate(([True], shape[1:] != shape[:-1])) if len(shape) else np.zeros(0, bool)
    keep[starts] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return Rolling(_BYTE_VALUE[shape[keep]], _BYTES).spans(at[starts], at[ends])


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family and order: the places of a run of texts' n-grams, and each text's first one and how many."""
    starts, ends, bounds = words_of(data, offsets)
    for family, values in enumerate((word_hashes(_LOWER[data], starts, ends), shape_hashes(data, starts, ends))):
        rolling = Rolling(values)
        for n in ORDERS:
            grams = rolling.windows(n)
            size = np.maximum(np.diff(bounds) - n + 1, 0)
            places = mixed(grams ^ np.uint64(0x5851F42D4C957F2D * (family * 8 + n) % 2**64)) >> np.uint64(64 - BITS)
            yield places.astype(np.int64), bounds[:-1], size


def margins(weights: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.full(len(offsets) - 1, bias)
    for places, first, size in features(data, offsets):
        sums = np.concatenate(([0.0], np.cumsum(weights[places])))
        first = np.minimum(first, len(places))
        total += FAMILY * (sums[np.minimum(first + size, len(places))] - sums[first]) / np.maximum(size, 1)
    return total


class Follower:
    """FTRL-proximal logistic regression over sparse rows."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def learn(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, balance: tuple[float, float]) -> None:
        parts = list(features(data, offsets))
        for k, label in enumerate(labels.tolist()):
            found = [(p[f[k]:f[k] + s[k]], FAMILY / max(s[k], 1)) for p, f, s in parts]
            at, inverse = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
            x = np.bincount(inverse, np.concatenate([np.full(len(p), v) for p, v in found]), len(at))
            self.update(np.append(at, 1 << BITS), np.append(x, 1.0), label, balance[label])


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from rows (id, text, label); both labels weigh the same in all. Without both, all weights are 0.

    One task holds all rows, so the caller bounds them (``bounded``). Rows with other labels are left out.
    """
    chosen = labelled.select(F.xxhash64("id").alias("turn"), "id", F.coalesce("text", F.lit("")).alias("text"),
                             F.col("label").cast("int").alias("label")).where("label in (0, 1)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        labels = np.concatenate([b.column("label").to_numpy() for b in batches] or [np.zeros(0)]).astype(np.int64)
        counts = np.bincount(labels, minlength=2)
        model = Follower()
        if counts.all():
            balance = tuple(len(labels) / (2 * counts))
            done = 0
            for batch in batches:
                for low, high, data, offsets in text_parts(batch.column("text")):
                    model.learn(data, offsets, labels[done + low:done + high], balance)
                done += len(batch)
        weights = model.weights().astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    rows = chosen.repartition(1).sortWithinPartitions("turn", "id", "label", "text").select("text", "label")
    found = rows.mapInArrow(run, "weights binary").collect()
    weights = np.frombuffer(found[0]["weights"], np.float32).astype(np.float64) if found else np.zeros((1 << BITS) + 1)
    return weights[:-1], float(weights[-1])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with score (0 to 1) and predicted (1 from the threshold on); null scores as the empty text, by the bias.

    All columns are kept but the text; columns named score or predicted are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema if f.name not in (text_col, "score", "predicted")]
    rows = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in rest)).alias("rest") if rest else F.lit(0).alias("rest"),
                       F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            found = [margins(weights, bias, data, offsets) for _, _, data, offsets in text_parts(batch.column("text"))]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate([*found, np.zeros(0)]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(score)], ["rest", "score"])

    out = rows.mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, score double")
    return out.select(*([F.col("rest.*")] if rest else []), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out)
    model = train(docs.join(bounded(labels, SAMPLE, "doc_id"), "doc_id").withColumnRenamed("doc_id", "id"))
    return scored(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model)
