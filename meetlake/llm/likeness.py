"""Links between texts whose sets of word shingles have a Jaccard similarity of a given percentage or more; exact.

Of two such sets each shares so many shingles with the other that their first ones in any common order (a fifth of them at 80
percent) already share one. These first shingles are the keys under which texts meet; the order puts shingles that are frequent
in a sample last, which saves meetings and changes no result.

* Texts with equal sets are one node. Keys of a single node are counted away before any posting is kept.
* Nothing but pairs that may be similar leaves a key: sizes, the places of the shared key in both orders, and a bitmap of each set
  bound what two sets can share. A bitmap holds the parity of the shingles that fall on a bit, so every bit in which two differ
  is a shingle that only one of them has. Whole sets travel for the pairs that pass all three, once a pair.
* A crowd of near copies shares its keys. So the nodes of a key are first compared with one of them, twice with another one; what
  that links counts as one, and only nodes of a key that are still apart are then compared with each other, in slices of a
  bounded size, so a frequent key is dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlake.llm.components import components
from meetlake.llm.shared import (
    Rolling, as_long, bounded, discard, list_array, mixed, row_key, staged, text_parts, word_hashes, words_of,
)

WORDS = 5
#: Nodes of a key that one task compares with the others of the key, and pairs that it looks at at a time.
SLICE, LOOKED = 4096, 1 << 20
#: Times that the nodes of a key are compared with one of them.
HUBS = 2
#: Rows of the sample that shingles are counted in, the least count of a frequent one, and how many are told to the tasks.
SAMPLE, FREQUENT, TOLD = 10_000, 3, 1 << 17


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Of every text the ascending hashes of its distinct shingles; a shorter text is one shingle, one without words none."""
    for _, _, data, offsets in text_parts(column):
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        starts, ends, bounds = words_of(data, offsets)
        rolling = Rolling(word_hashes(data, starts, ends))
        grams = rolling.windows(words)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield np.unique(grams[a:b - words + 1]) if b - a >= words else rolling.spans(
                np.array([a] * (b > a), np.int64), np.array([b] * (b > a), np.int64))


def _arrays(sets: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return list_array(as_long(flat), np.cumsum([len(s) for s in sets]), pa.int64())


def _sets_of(rows: DataFrame, name: str, words: int) -> DataFrame:
    """(name, s): the shingles of every row's text beside its column ``name``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(name), _arrays(list(shingle_sets(batch.column("text"), words)))],
                                             [name, "s"])
    return rows.select(name, "text").mapInArrow(run, f"{name} bigint, s array<bigint>")


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles on each bit; as many bits as shingles at least, a power of two from 64 on."""
    size = max(64, 1 << (max(len(shingles), 1) - 1).bit_length())
    bits = np.bincount((mixed(shingles) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Differing bits of bitmaps, row by row; a longer bitmap is folded to the shorter one's length, which keeps the parities."""
    while one.shape[1] > two.shape[1]:
        one = one[:, :one.shape[1] // 2] ^ one[:, one.shape[1] // 2:]
    while two.shape[1] > one.shape[1]:
        two = two[:, :two.shape[1] // 2] ^ two[:, two.shape[1] // 2:]
    return np.bitwise_count(one ^ two).sum(1, dtype=np.int64)


class Bitmaps:
    """The bitmaps of some nodes, as one matrix for each length."""

    def __init__(self, column: list[bytes]):
        self.length = np.array([len(b) for b in column], np.int64)
        self.row = np.zeros(len(column), np.int64)
        self.rows = {}
        for size in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == size)
            self.row[at] = np.arange(len(at))
            self.rows[size] = np.frombuffer(b"".join(column[k] for k in at.tolist()), np.uint8).reshape(-1, size)


def may_be_alike(one: Bitmaps, i: np.ndarray, two: Bitmaps, j: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (i, j) of nodes, whose sets have so many shingles together, can have the similarity by their bitmaps."""
    out = np.zeros(len(i), bool)
    kind = one.length[i] * (1 << 32) + two.length[j]
    for pair in np.unique(kind).tolist():
        at = np.flatnonzero(kind == pair)
        differ = apart(one.rows[pair >> 32][one.row[i[at]]], two.rows[pair & (1 << 32) - 1][two.row[j[at]]])
        # what is shared is half of all less what is not
        out[at] = (100 + percent) * (sizes[at] - differ) >= 2 * percent * sizes[at]
    return out


def _keyed(rows: DataFrame, percent: int, words: int) -> DataFrame:
    """(k1, k2, sig, n, keys, bits): the set's name and size, the shingles under which it meets others in order, its bitmap."""
    told = _sets_of(bounded(rows, SAMPLE, "k2"), "k2", words).select(F.explode("s").alias("g")).groupBy("g").count().where(
        F.col("count") >= FREQUENT).orderBy(F.desc("count"), "g").limit(TOLD).orderBy("g").toArrow()
    hot, counts = (told.column(c).to_numpy().astype(np.int64) for c in ("g", "count"))
    sent = rows.sparkSession.sparkContext.broadcast((hot, np.concatenate((np.zeros(1, np.int64), counts))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = sent.value
        for batch in batches:
            names, sizes, keys, bits = [], [], [], []
            for s in shingle_sets(batch.column("text"), words):
                at = np.searchsorted(hot, as_long(s))
                known = np.flatnonzero(at < len(hot))
                known = known[hot[at[known]] == as_long(s)[known]]
                often = np.zeros(len(s), np.int64)
                often[known] = counts[at[known] + 1]
                first = np.lexsort((s, often))[:len(s) - -(-percent * len(s) // 100) + 1]
                names.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                keys.append(s[first])
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(as_long(np.array(names, np.uint64))),
                 pa.array(sizes, pa.int32()), _arrays(keys), pa.array(bits, pa.binary())], ["k1", "k2", "sig", "n", "keys", "bits"])

    return staged(rows.mapInArrow(run, "k1 bigint, k2 bigint, sig bigint, n int, keys array<bigint>, bits binary"), "shingle-keys")


def _fits(percent: int) -> str:
    """Whether two nodes whose first shared key has the places pos and pos2 can be similar, by sizes n and n2."""
    return (f"100 * n >= {percent} * n2 AND 100 * n2 >= {percent} * n "
            f"AND {100 + percent} * least(n - pos, n2 - pos2) >= {percent} * (n + n2)")


def _alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int, words: int) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets have the wanted similarity. Sets are read from one row's text for each node."""
    wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    chosen = nodes.join(wanted, "sig").select("sig", "k1", "k2")
    sets = staged(_sets_of(rows.join(chosen, ["k1", "k2"]).dropDuplicates(["sig"]), "sig", words), "shingle-sets")
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("sig").alias("b"), F.col("s").alias("sb")), "b")
    out = staged(both.where((100 + percent) * F.size(F.array_intersect("sa", "sb"))
                            >= percent * (F.size("sa") + F.size("sb"))).select("a", "b"), "alike")
    discard(sets)
    return out


def _by_hub(placed: DataFrame, nodes: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of postings (key, sig, n, pos, root) with one posting of their key that is apart from them, if they may be
    similar."""
    hub = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "sig"), "sig", "n", "pos", "root")).alias("h")).select(
        "key", F.col("h.sig").alias("sig2"), F.col("h.n").alias("n2"), F.col("h.pos").alias("pos2"), F.col("h.root").alias("root2"))
    pairs = placed.join(hub, "key").where(f"root <> root2 AND {_fits(percent)}").select(
        F.least("sig", "sig2").alias("a"), F.greatest("sig", "sig2").alias("b"), (F.col("n") + F.col("n2")).alias("sizes")).distinct()
    both = pairs.join(nodes.select(F.col("sig").alias("a"), F.col("bits").alias("one")), "a").join(
        nodes.select(F.col("sig").alias("b"), F.col("bits").alias("two")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(len(batch))
            ok = may_be_alike(Bitmaps(batch.column("one").to_pylist()), at, Bitmaps(batch.column("two").to_pylist()), at,
                              batch.column("sizes").to_numpy().astype(np.int64), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return staged(both.mapInArrow(run, "a bigint, b bigint"), "hub-pairs")


def _compared(percent: int):
    """Pairs (a, b) that may be similar, of rows (key, slice, own, sig, n, pos, root, bits) by key and slice, own ones first.

    Own rows of a slice are compared with each other and with the slice's other rows, which pass by in blocks.
    """
    def ordered(rows: list[tuple]) -> dict:
        cols = list(zip(*rows))
        return {"sig": np.array(cols[3], np.int64), "n": np.array(cols[4], np.int64), "pos": np.array(cols[5], np.int64),
                "root": np.array(cols[6], np.int64), "bits": Bitmaps(list(cols[7]))}

    def pairs(one: dict, two: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, LOOKED // max(len(two["sig"]), 1))
        for low in range(0, len(one["sig"]), step):
            n, n2 = one["n"][low:low + step, None], two["n"][None]
            left = np.minimum(n - one["pos"][low:low + step, None], n2 - two["pos"][None])
            ok = ((100 * n >= percent * n2) & (100 * n2 >= percent * n) & ((100 + percent) * left >= percent * (n + n2))
                  & (one["root"][low:low + step, None] != two["root"][None]))
            if one is two:
                ok &= np.arange(low, low + len(n))[:, None] < np.arange(n2.shape[1])[None]
            i, j = np.nonzero(ok)
            i += low
            near = may_be_alike(one["bits"], i, two["bits"], j, one["n"][i] + two["n"][j], percent)
            a, b = one["sig"][i[near]], two["sig"][j[near]]
            yield np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            place, own, held, waiting = None, None, [], []
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("key", "slice", "own", "sig", "n", "pos", "root", "bits"))):
                    if row[:2] != place:
                        yield from settle(own, held, waiting)
                        place, own, held, waiting = row[:2], None, [], []
                    if row[2]:
                        held.append(row)
                    else:
                        if own is None:
                            own = ordered(held)
                        waiting.append(row)
                        if len(waiting) == SLICE:
                            yield from pairs(own, ordered(waiting))
                            waiting = []
            yield from settle(own, held, waiting)

        def settle(own: dict | None, held: list, waiting: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if held:
                own = own or ordered(held)
                yield from pairs(own, own)
                if waiting:
                    yield from pairs(own, ordered(waiting))

        for a, b in found():
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return run


def _among_others(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar of the postings (key, sig, n, pos, root) of each key whose nodes are apart."""
    sized = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    counts = sized.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias(
        "m")).where("roots > 1").select("key", F.col("m.root").alias("major"),
                                        F.ceil((F.col("all") - F.col("m.c")) / SLICE).cast("int").alias("slices"))
    rows = placed.join(counts, "key").join(nodes.select("sig", "bits"), "sig").withColumn(
        "at", F.when(F.col("root") == F.col("major"), F.col("slices")).otherwise(F.pmod(F.xxhash64("sig"), F.col("slices"))).cast("int"))
    # a row is its own slice's and passes by those before it, so two slices meet once; the nodes of the largest root are apart
    # from all others but not from each other, so they only pass by
    dealt = rows.select("key", F.explode(F.expr("sequence(0, least(at, slices - 1))")).alias("slice"), "at", "sig", "n", "pos", "root",
                        "bits").select("key", "slice", (F.col("slice") == F.col("at")).alias("own"), "sig", "n", "pos", "root", "bits")
    met = dealt.repartition("key", "slice").sortWithinPartitions("key", "slice", F.desc("own"))
    return staged(met.mapInArrow(_compared(percent), "a bigint, b bigint").distinct(), "near-pairs")


def similar_links(docs: DataFrame, found: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text",
                  words: int = WORDS) -> DataFrame:
    """Links (a, b) between values of the column fp of ``found`` (k1, k2, fp: one for every row's key) that join all rows
    whose texts are similar by ``percent``, over any number of links.

    Null and empty texts and texts without words have no shingles and link with nothing here. Ids may be null or repeat.
    """
    rows = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    keyed = _keyed(rows, percent, words)
    nodes = staged(keyed.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias(
        "bits"), F.min(F.struct("k1", "k2")).alias("r")).select("sig", "n", "keys", "bits", "r.k1", "r.k2"), "shingle-nodes")
    named = staged(keyed.where("n > 0").select("k1", "k2", "sig").distinct().join(
        found.select("k1", "k2", "fp").distinct(), ["k1", "k2"]).select("sig", "fp").distinct(), "shingle-names")
    discard(keyed)
    posted = nodes.select("sig", "n", F.posexplode("keys").alias("pos", "key"))
    met = staged(posted.groupBy("key").count().where("count > 1").select("key"), "met-keys")
    shared = staged(posted.join(met, "key").select("key", "sig", "n", "pos"), "shared-postings")
    discard(met)

    links = None
    for turn in range(HUBS + 1):
        if links is None:
            placed = shared.withColumn("root", F.col("sig"))
        else:
            roots = components(links)
            placed = shared.join(roots, shared["sig"] == roots["node"], "left").select(
                "key", "sig", "n", "pos", F.coalesce("root", "sig").alias("root"))
        pairs = _by_hub(placed, nodes, percent, turn) if turn < HUBS else _among_others(placed, nodes, percent)
        if not pairs.isEmpty():
            alike = _alike(pairs, nodes, rows, percent, words)
            links = alike if links is None else links.unionByName(alike)
        discard(pairs)

    least = named.groupBy("sig").agg(F.min("fp").alias("least"))
    out = named.join(least, "sig").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    if links is not None:
        out = out.unionByName(
            links.join(least.select(F.col("sig").alias("a"), F.col("least").alias("x")), "a")
            .join(least.select(F.col("sig").alias("b"), F.col("least").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = staged(out.where("a <> b").distinct(), "similar-links")
    for stage in (nodes, named, shared):
        discard(stage)
    return out
