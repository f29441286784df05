"""Byte-level BPE encoding and decoding with a local rank file, by the tiktoken library.

The driver reads the rank file once and broadcasts it (its size is that of the vocabulary, whatever the corpus); a Python
worker builds the encoder once. A long text is cut at places that the pattern can't match across, so that the library
sees bounded pieces, and the pieces' ids are those of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.shared import table

#: Characters of a text that go to the library at once, where a safe boundary follows.
PIECE = 1 << 16
#: Bytes of results in one Arrow batch.
BATCH = 4 << 20
#: Space or line feed after a character that is no white space: with byte-level patterns, white space only begins a match or
#: is matched alone, so a match always begins here.
_BOUNDARY = re.compile(r"(?<=\S)[ \n]")


@lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str):
    import tiktoken
    table_ = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces that begin at safe boundaries, each as short as they allow but at least ``size`` long."""
    start = 0
    while start < len(text):
        found = _BOUNDARY.search(text, start + size) if len(text) - start > size else None
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def encode(encoding, text: str, size: int = PIECE) -> np.ndarray:
    if len(text) <= size:
        return np.array(encoding.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(encoding.encode_ordinary(p), "<u4") for p in pieces(text, size)])


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The rows with n_tokens, ids (little-endian unsigned 32-bit integers, binary) and, if wanted, the bytes decoded from them.

    Null counts as empty: no ids. All other columns are kept; columns that have the new names are replaced. The text
    column is dropped.
    """
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    new = {"n_tokens": "bigint", "ids": "binary"} | ({"decoded": "binary"} if decoded else {})
    rest = [f for f in docs.schema if f.name != text_col and f.name not in new]
    docs = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in rest)).alias("rest") if rest else F.lit(0).alias("rest"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = f"rest {docs.schema['rest'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in new.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value, pattern)
        for batch in batches:
            texts, start, rows, held = batch.column("text"), 0, [], 0
            for k in range(len(texts)):
                ids = encode(encoding, texts[k].as_py())
                row = [len(ids), ids.tobytes()]
                if decoded:
                    row.append(encoding.decode_bytes(ids.tolist()))
                rows.append(row)
                held += sum(map(len, row[1:]))
                if held >= BATCH or k == len(texts) - 1:
                    kinds = [pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("rest").slice(start, k + 1 - start),
                         *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["rest", *new])
                    start, rows, held = k + 1, [], 0

    return docs.mapInArrow(run, schema).select(*([F.col("rest.*")] if rest else []), *new)


def local_ranks() -> tuple[str, str]:
    """Rank file and pattern of the installed public vocabulary for many languages."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, *local_ranks(), decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
