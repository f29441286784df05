"""Ranked search against a plain loop over all items and documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meetlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for (ident, bag), n in zip(bags, sizes):
            if n:
                m = 50 + (50 * n * n_docs) // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                            for t in wanted if t in bag)
                if score > 0:
                    found.append((-score, ident is None, ident or 0, ident))
        found.sort(key=lambda f: f[:3])
        out += [(item, rank, ident, -score) for rank, (score, _, _, ident) in enumerate(found[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["the", "The", "a1", "ÉTÉ", "été", "naïve", "x", "über", *("w%d" % k for k in range(60))]
    texts = [" ".join(rng.choice(vocabulary[:rng.randint(3, 68)]) + rng.choice(["", ",", "-b", "_"]) for _ in range(rng.randint(0, 40)))
             for _ in range(160)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(300 + k, texts[k % 4]) for k in range(200)]  # crowds of copies
    docs += [(None, texts[0]), (7, texts[7]), (7, texts[9]), (900, None), (901, ""), (902, " .,;"), (903, "w1 " * 30_000 + "the")]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for k in range(25)]
    items += [(50, None), (51, ""), (52, "unknown words only"), (53, "w1"), (53, "w2 the"), (54, texts[0]), (54, texts[0]), (None, "w1")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id bigint, text string, class string, n int").repartition(3),
            spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, score int"))


def test_all_items(spark, corpus):
    docs, items = corpus
    assert rows_of(lexical.ranked(*frames(spark, docs, items))) == plain(docs, items)


def test_fewer_places_and_blocks_of_items(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 8)
    docs, items = corpus
    assert rows_of(lexical.ranked(*frames(spark, docs, items), k=3)) == plain(docs, items, 3)


def test_names_of_classes_are_verified(spark, monkeypatch):
    """A hash that two vectors share gives way to another one."""
    held = spark.createDataFrame([(1, 5, [1], [2]), (2, 5, [1], [2]), (3, 5, [2], [1]), (4, 5, [], [])],
                                 "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")
    real = F.xxhash64
    monkeypatch.setattr(lexical.F, "xxhash64", lambda seed, *c: F.lit(7).cast("bigint") if "0" in str(seed) else real(seed, *c))
    named, classes = lexical.classed(held, 3, 15)
    got = {r["doc_id"]: r["class"] for r in named.collect()}
    assert got[1] == got[2] != got[3] and 4 not in got
    assert {(r["members"], r["least"]) for r in classes.collect()} == {(2, 1), (1, 3)}


def test_empty_tables(spark, corpus):
    docs, items = frames(spark, *corpus)
    assert lexical.ranked(docs.limit(0), items).collect() == []
    assert lexical.ranked(docs, items.limit(0)).collect() == []
    assert lexical.ranked(docs.where("doc_id in (900, 901, 902)"), items).collect() == []


def test_pieces_hold_all_terms():
    import pyarrow as pa
    texts = ["one two", None, "", "x" * 5000 + " é" * 3000, "three", " a", "b "]
    data, offsets = lexical.flat(pa.array(texts))
    for size in (1, 7, 64, 10**6):
        found = [(int(np.searchsorted(offsets, low + a, "right")) - 1, piece[a:b].tobytes().decode())
                 for low, piece, starts, ends in lexical.term_pieces(data, offsets, size) for a, b in zip(starts, ends)]
        assert found == [(n, t) for n, text in enumerate(texts) for t in terms(text)]
