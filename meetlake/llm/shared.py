"""Helpers that several operators use: staging in the shared folder, and word and hash arrays over Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the array code takes at a time; a longer text is taken alone and whole.
CHUNK = 1 << 19
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(_SPACES)] = True

_LOCAL: dict[str, str] = {}
_STAGES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on a local master a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="llm-stage-")
    return _LOCAL[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a result that later steps read more than once as Parquet in the shared folder, and read it back.

    The written table cuts the lineage, so a lost executor costs only the tasks that it ran. Spark deletes the shuffle
    files of a finished job once the driver's collector finds it gone; a step asks for that, so that they don't pile up.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    _STAGES[out] = path
    return out


def discard(stage: DataFrame) -> None:
    """Delete a staged table that nothing reads any more: all that came of it has been staged itself."""
    jvm, path = stage.sparkSession.sparkContext._jvm, _STAGES.pop(stage)
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(stage.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(rows: DataFrame, limit: int, *key: str) -> DataFrame:
    """About ``limit`` rows at most, those whose key has a small hash: the choice depends on nothing but the keys and the count."""
    share = min(1.0, limit / max(rows.count(), 1))
    return rows if share == 1.0 else rows.where(F.shiftrightunsigned(F.xxhash64(*key), 11) < F.lit(int(share * (1 << 53))))


def row_key(ident: Column, text: Column) -> list[Column]:
    """Two columns that name a row by its id and text: rows that agree in both are repeats with equal results."""
    return [F.coalesce(ident.cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(text).alias("k2")]


# --- arrays over Arrow batches -----------------------------------------------------------------------------------


def text_parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows: first row, end row, the bytes, and each text's start in them.

    Null counts as empty. A run holds CHUNK bytes, or one longer text.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (with an end)."""
    return runs_of(~IS_SPACE[data], offsets)


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of true places; runs end where a text does. The first run of each text (with an end)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as longer inputs come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, step in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _TOKENS = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)
_BYTE_VALUE = np.random.default_rng(20240901).integers(0, 2**64, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values, so that low and high bits are alike."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Rolling:
    """Hashes of any span of a sequence of 64-bit values, each from two look-ups."""

    def __init__(self, values: np.ndarray, powers: Powers = _TOKENS):
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    @classmethod
    def over_bytes(cls, data: np.ndarray) -> Rolling:
        return cls(_BYTE_VALUE[data], _BYTES)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """The hash of every span of n values."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[n:] - self.sums[:-n]) * self.down[:len(self.sums) - n])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling.over_bytes(data).spans(starts, ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, in three passes whatever the width."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1:width - 1 + count])


def list_array(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of one flat array, cut at ``ends``."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
