"""The manifest against a tree built in one process."""

import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from meetlake.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """Root of the nodes and for each its steps (siblings before, after)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, place in enumerate(at):
            run = nodes[place // 16 * 16:place // 16 * 16 + 16]
            steps[leaf].append((run[:place % 16], run[place % 16 + 1:]))
        nodes = [h(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
        at = [place // 16 for place in at]
    return nodes[0], steps


def plain(rows, tampered):
    sources = {}
    for row in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"]) if row["text"] is not None else None
        sources.setdefault(row["source"], []).append((row["doc_id"], leaf_of(row, row["text"]), leaf_of(row, low)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = climb([r[1] for r in sources[name]])
    root, upper = climb([trees[n][0] for n in names])
    out = Counter()
    for name, above in zip(names, upper):
        subroot, steps = trees[name]
        for (ident, leaf, low), own in zip(sources[name], steps):
            path = own + above
            node = low if ident is not None and tampered(ident) else leaf
            for before, after in path:
                node = h(*before, node, *after)
            proof = h(*(x for before, after in path for x in before + after))
            out[ident, leaf, subroot, root, proof, node, node == root] += 1
    return out


def fifth(ident):
    return zlib.crc32(str(ident).encode()) % 5 == 0


def made(docs):
    ident = F.crc32(F.col("doc_id").cast("string"))
    return merkle.manifest(docs, F.coalesce(ident % 5 == 0, F.lit(False)), F.translate("text", merkle._UPPER, merkle._LOWER))


def test_odd_rows(odd_docs):
    got = Counter(tuple(r) for r in made(odd_docs).collect())
    assert got == plain(odd_docs.collect(), fifth)


def test_hot_source_lone_rows_and_many_sources(spark):
    """A source beyond one block, sources of 1, 16, 17 and 256 rows, null beside the empty one, and repeated rows."""
    sizes = {"hot": 700, "one": 1, "edge": 16, "over": 17, "block": 256, None: 3, "": 2, "é": 2, **{f"s{k}": 1 for k in range(20)}}
    rows, ident = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            ident += 7
            rows.append((ident % 100_003, f"Text {ident} ÄB" if ident % 11 else None, "en", source, ident))
    rows += [rows[5]] * 20 + [(None, "A", "x", "hot", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    got = made(docs).collect()
    assert Counter(tuple(r) for r in got) == plain(docs.collect(), fifth)
    assert {r["verified"] for r in got} == {True, False}


def test_proofs_fold_to_the_root(odd_docs):
    rows = merkle.manifest(odd_docs, proofs=True).collect()
    for r in rows:
        steps = [(s["at"], s["siblings"].encode()) for s in r["proof"]]
        assert merkle.folded(r["leaf"].encode(), steps).decode() == r["root"] == r["folded_root"] and r["verified"]
        assert hashlib.sha256(b"".join(s for _, s in steps)).hexdigest() == r["proof_sha256"]


def test_no_rows(no_docs):
    assert made(no_docs).collect() == []


def test_a_leaf_alone_and_incremental_appends():
    tree = merkle.Appender(2)
    leaves = [merkle.digest(str(k).encode()) for k in range(40)]
    for n, leaf in enumerate(leaves):
        tree.append(leaf)
        assert [len(s) for s in tree.steps] == [1 if k < (n + 1) // 16 * 16 else 0 for k in range(n + 1)]
    root = tree.close()
    assert all(merkle.folded(leaf, steps) == root for leaf, steps in zip(leaves, tree.steps))
    alone = merkle.Appender(0)
    alone.append(leaves[0])
    assert alone.close() == leaves[0] and alone.steps == [[]]
