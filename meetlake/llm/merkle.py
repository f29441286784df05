"""Merkle manifest of a table of documents, with an inclusion proof for every row.

A row's leaf is a digest of its fields. The rows of a source ascend by id; runs of ``WIDTH`` nodes become their digest, level
by level, until one is left, the source's subroot. The subroots, ordered by source, give the root in the same way.

* Witnesses grow by streaming aligned append (``Appender``): a node that is appended opens a partial witness for all
  leaves below it; when its run is complete, its siblings extend that witness, and the run's digest is appended one level up.
* The appends are distributed: places in a source come from a range partition and a sum over its parts, so a source is
  dealt over as many tasks as it has blocks of ``WIDTH ** LEVELS`` leaves. A block's root is appended again, with the roots of
  other blocks, in the next round; a round has 256 times fewer nodes than the one before.
* Witnesses come down the same way: a block's own witness enters its stream before its members. No step joins on a source,
  and no task holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.shared import discard, staged, table

WIDTH, LEVELS = 16, 2
BLOCK = WIDTH**LEVELS
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: bytes) -> bytes:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def depth(nodes: int) -> int:
    """Levels from so many nodes to one."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // WIDTH), levels + 1
    return levels


class Appender:
    """A subtree of a given height to which leaves are appended in order; ``steps`` holds each leaf's witness so far.

    A step is the leaf's place in its run and the run's other digests. Open runs are the only state besides the witnesses.
    """

    def __init__(self, height: int):
        self.height, self.root = height, None
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(height)]
        self.steps: list[list[tuple[int, bytes]]] = []

    def append(self, leaf: bytes) -> None:
        self.steps.append([])
        self._push(0, leaf, len(self.steps) - 1, len(self.steps))

    def _push(self, level: int, node: bytes, first: int, end: int) -> None:
        if level == self.height:
            self.root = node
            return
        self.open[level].append((node, first, end))
        if len(self.open[level]) == WIDTH:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = b"".join(node for node, _, _ in run)
        for at, (_, first, end) in enumerate(run):
            step = at, nodes[:64 * at] + nodes[64 * at + 64:]
            for leaf in range(first, end):
                self.steps[leaf].append(step)
        self._push(level + 1, digest(nodes), run[0][1], run[-1][2])

    def close(self) -> bytes:
        """Complete the last, shorter runs; the root of what was appended."""
        for level in range(self.height):
            if self.open[level]:
                self._complete(level)
        return self.root


def folded(leaf: bytes, steps: Sequence[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its witness give."""
    for at, rest in steps:
        leaf = digest(rest[:64 * at], leaf, rest[64 * at:])
    return leaf


# --- leaves and places -------------------------------------------------------------------------------------------


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                                     for t in texts]), 256))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (grp, ...) with pos, the place from 0 in the group by ``order``, and total, the group's size.

    The order columns must tell all rows of a group apart. Rows are dealt by ranges of (grp, order), so a large group lies in
    many parts; sums are taken over one row a part and group.
    """
    dealt = staged(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")), "merkle-ranged")
    runs = dealt.groupBy("part", "grp").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.select("part", "grp", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                              F.sum("n").over(Window.partitionBy("grp")).alias("total")), "merkle-runs")
    placed = staged(dealt.join(runs, ["part", "grp"]).withColumn("pos", F.col("line") - F.col("first") + F.col("base")).drop(
        "part", "line", "first", "base"), "merkle-placed")
    discard(dealt)
    discard(runs)
    return placed


# --- up and down the tree ----------------------------------------------------------------------------------------


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows dealt by block of their group, each block's in order; a witness (pos -1) first."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple]]]:
    """(grp, block, rows) of a stream of rows (grp, block, pos, ...) in that order."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != key:
                if rows:
                    yield *key, rows
                key, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield *key, rows


def _grown(total: int, leaves: Iterator[bytes]) -> Appender:
    """The subtree of one block of a group with so many nodes in this round."""
    tree = Appender(min(LEVELS, depth(total)))
    for leaf in leaves:
        tree.append(leaf.hex().encode())
    tree.close()
    return tree


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for grp, block, members in _streamed(batches):
            total = members[0][1]
            yield grp, block, -(-total // BLOCK), bytes.fromhex(_grown(total, (m[2] for m in members)).root.decode())
    yield from _packed(rows(), _NODE)


def _packed(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_STEPS = pa.list_(pa.struct([("at", pa.int32()), ("rest", pa.binary())]))
_NODE = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("digest", pa.binary())])
_WITNESS = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("steps", _STEPS), ("top", pa.binary())])
_STEPS_SQL = "array<struct<at: int, rest: binary>>"
_NODE_SQL = "grp string, pos bigint, total bigint, digest binary"
_WITNESS_SQL = f"grp string, pos bigint, steps {_STEPS_SQL}, top binary"


def grown(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (grp, digest, round) of all groups, and the nodes of each round; nodes are (grp, pos, total, digest)."""
    rounds, tops = [nodes], []
    while True:
        level = rounds[-1].select("grp", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "total", "digest")
        above = staged(_in_blocks(level).mapInArrow(_roots, _NODE_SQL), "merkle-nodes")
        tops.append(above.where("total = 1").select("grp", "digest", F.lit(len(rounds) - 1).alias("round")))
        above = above.where("total > 1")
        if above.isEmpty():
            roots = tops[0]
            for top in tops[1:]:
                roots = roots.unionByName(top)
            return roots, rounds
        rounds.append(above)


def _steps(found: list) -> list[tuple[int, bytes]]:
    return [(s["at"], s["rest"]) for s in found]


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for grp, _, (witness, *members) in _streamed(batches):
            above, top = _steps(witness[3]), witness[4]
            tree = _grown(members[0][1], (m[2] for m in members))
            for member, steps in zip(members, tree.steps):
                yield grp, member[0], [{"at": a, "rest": r} for a, r in [*steps, *above]], top
    yield from _packed(rows(), _WITNESS, 256)


def _with_witness(nodes: DataFrame, witness: DataFrame, *payload: str) -> DataFrame:
    """Members of blocks (grp, block, pos, total, digest, steps, top, payload), each block's witness before them."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("steps", _STEPS_SQL), ("top", "binary"))]
    members = nodes.select("grp", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "total", "digest", *none, *payload)
    own = witness.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"),
                         F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("binary").alias("digest"), "steps", "top",
                         *[F.lit(None).cast(nodes.schema[p].dataType).alias(p) for p in payload])
    return _in_blocks(members.unionByName(own))


def brought_down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Witnesses (grp, pos, steps, top) of the blocks of the first round, from those of the groups' roots (.., round)."""
    here = None
    for at in range(len(rounds) - 1, -1, -1):
        own = tops.where(F.col("round") == at).select("grp", F.lit(0).cast("bigint").alias("pos"), "steps", "top")
        here = own if here is None else own.unionByName(here)
        if at:
            here = staged(_with_witness(rounds[at], here).mapInArrow(_down, _WITNESS_SQL), "merkle-witness")
    return here


# --- manifest ----------------------------------------------------------------------------------------------------

_RESULT = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()),
                     ("folded_root", pa.string()), ("proof", _STEPS)])


def _proofs(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, _, (witness, *members) in _streamed(batches):
                above, top = _steps(witness[3]), witness[4].hex()
                tree = _grown(members[0][1], (m[2] for m in members))
                for member, own in zip(members, tree.steps):
                    leaf, changed, steps = member[2].hex(), member[6], [*own, *above]
                    start = leaf if changed is None else changed.hex()
                    yield (member[5], leaf, top, digest(*(rest for _, rest in steps)).decode(),
                           folded(start.encode(), steps).decode(), [{"at": a, "rest": r} for a, r in steps] if whole else None)
        yield from _packed(rows(), _RESULT, 256 if whole else 2048)
    return run


def manifest(docs: DataFrame, tampered: Column | None = None, change: Column | None = None, fields: Sequence[str] = FIELDS,
             proofs: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; with ``proofs`` its proof as well.

    ``fields`` names id, source and other columns of the leaf, the text last. folded_root is what the row's proof gives for its
    leaf, or, where ``tampered`` holds, for the leaf of a row whose text is ``change``. A proof is a list of steps from the
    leaf to the root: the place in the run (from 0), and the run's other digests as hex text.

    Sources are compared as UTF-8 bytes, null before all others and apart from the empty one. Null ids come first in their
    source; rows of equal source and id ascend by leaf, and rows that repeat all fields get a place each. Null fields are
    marked in the leaf. A source with one row has that row's leaf as its subroot; an empty table gives no rows. Other columns
    are not looked at.
    """
    ident, source = (F.col(f"`{c}`") for c in fields[:2])
    columns = [F.col(f"`{c}`") for c in fields]
    changed = F.lit(None).cast("binary") if tampered is None else F.when(tampered, leaf_digest([*columns[:-1], change]))
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")).alias("grp"),
                         ident.cast("bigint").alias("doc_id"), leaf_digest(columns).alias("digest"), changed.alias("changed"),
                         F.monotonically_increasing_id().alias("turn"))
    placed = numbered(staged(leaves, "merkle-leaves"), ["doc_id", "digest", "turn"])
    roots, rounds = grown(placed.select("grp", "pos", "total", "digest"))
    roots = staged(roots, "merkle-subroots")
    ordered = numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", "round"), ["name"])
    top, upper = grown(ordered.select("grp", "pos", "total", "digest"))
    top = staged(top, "merkle-root")
    nothing = F.array().cast(_STEPS_SQL).alias("steps")
    down = brought_down(upper, top.select("grp", nothing, F.col("digest").alias("top"), "round"))
    steps = staged(_with_witness(ordered.select("grp", "pos", "total", "digest"), down).mapInArrow(_down, _WITNESS_SQL),
                   "merkle-sources")
    sources = ordered.select("pos", "name", "digest", "round").join(steps.select("pos", "steps"), "pos").select(
        F.col("name").alias("grp"), "steps", F.col("digest").alias("top"), "round")
    witness = brought_down(rounds, staged(sources, "merkle-source-witness"))
    found = _with_witness(placed, witness, "doc_id", "changed").mapInArrow(
        _proofs(proofs), "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string, "
                         f"proof {_STEPS_SQL}")
    root = top.select(F.lower(F.hex("digest"))).scalar()
    shown = ["doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
             (F.col("folded_root") == root).alias("verified")]
    if proofs:
        shown.append(F.transform("proof", lambda s: F.struct(s["at"].alias("at"), s["rest"].cast("string").alias("siblings"))).alias("proof"))
    return found.select(*shown)


def _sql() -> str:
    """The tree level by level, for up to 16 ** 6 rows a source and as many sources."""
    height = 6
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END".format
    head = " || ".join(field(f) for f in FIELDS[:-1])
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    sql = [f"""crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
leaves AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS h, sha256({head} || {field(lowered)}) AS low,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 5 = 0 AS tampered FROM documents, crc),
a0 AS (SELECT *, coalesce('=' || source, '') AS g, count(*) OVER (PARTITION BY source) AS c,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves)"""]

    def levels(name: str) -> str:
        for k in range(height):
            here = f"{name}{k}"
            sql.append(f"""{name}{k + 1} AS (SELECT g, i // 16 AS i, (any_value(c) + 15) // 16 AS c,
    CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {here} GROUP BY g, i // 16),
{name}s{k} AS (SELECT x.g, x.i, any_value(x.c) AS c, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l,
    coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
    FROM {here} x JOIN {here} y ON x.g = y.g AND x.i // 16 = y.i // 16 GROUP BY x.g, x.i)""")
        return f"{name}{height}"

    tops = levels("a")
    sql.append(f"b0 AS (SELECT '' AS g, g AS name, h, count(*) OVER () AS c, row_number() OVER (ORDER BY g) - 1 AS i FROM {tops})")
    root = levels("b")
    start, proof = "CASE WHEN tampered THEN low ELSE d.h END", []
    joins = []
    for name, key in (("a", "d"), ("b", "m")):
        for k in range(height):
            s = f"{name}{k}_"
            joins.append(f"JOIN {name}s{k} {s} ON {s}.g = {key}.g AND {s}.i = {key}.i // {16**k}")
            proof += [f"{s}.l", f"{s}.r"]
        if name == "a":
            joins.append("JOIN b0 m ON m.name = d.g")
    for n, s in enumerate([f"{n}{k}_" for n in "ab" for k in range(height)]):
        sql.append(f"f{n} AS (SELECT * EXCLUDE (x), CASE WHEN {s}c = 1 THEN x ELSE sha256({s}l || x || {s}r) END AS x FROM "
                   + ("w)" if n == 0 else f"f{n - 1})"))
    parts = ", ".join(f"{s}.c AS {s}c, {s}.l AS {s}l, {s}.r AS {s}r" for s in [f"{n}{k}_" for n in "ab" for k in range(height)])
    sql.insert(len(sql) - 2 * height, f"""w AS (SELECT d.doc_id, d.h AS leaf, m.h AS subroot, sha256({' || '.join(proof)}) AS proof_sha256,
    {start} AS x, {parts} FROM a0 d {' '.join(joins)})""")
    return f"""WITH {', '.join(sql)}
SELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified
FROM f{2 * height - 1}, (SELECT h AS root FROM {root})"""


@query("op12_merkle_manifest", _sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.crc32(F.col("doc_id").cast("string"))
    return manifest(table(spark, sf_dir, "documents"), F.coalesce(ident % 5 == 0, F.lit(False)),
                    F.translate("text", _UPPER, _LOWER))
