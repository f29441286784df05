"""Links of similar texts against the sets of all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meetlake.llm import likeness, simhash
from tests.llm.conftest import prose


def sets_of(texts, words=5):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def wanted_groups(texts, percent):
    sets, root = sets_of(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if union and 100 * both >= percent * union:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def crowds(rng):
    """Chains of edits, a passage that many texts share, crowds around a base, copies, and short texts."""
    texts, passage = [], prose(rng, 45)
    for _ in range(4):
        words = prose(rng, rng.randint(30, 200)).split()
        for _ in range(9):
            words = list(words)
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    for _ in range(25):
        texts.append(prose(rng, rng.randint(0, 60)) + " " + passage + " " + prose(rng, rng.randint(5, 60)))
    base = prose(rng, 100).split()
    for _ in range(30):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    return texts + [texts[0], None, "", "a b", "A  B", "a b c d e f g", "a b c d e f h", passage]


@pytest.mark.parametrize("slice_, hubs, percent", [(4096, 2, 80), (4, 0, 80), (7, 1, 60)])
def test_groups_are_those_of_all_pairs(spark, make_docs, monkeypatch, slice_, hubs, percent):
    monkeypatch.setattr(likeness, "SLICE", slice_)
    monkeypatch.setattr(likeness, "HUBS", hubs)
    texts = crowds(random.Random(slice_))
    docs = make_docs(list(enumerate(texts)))
    # without a budget of bits, links come from the sets alone (and from equal fingerprints)
    found = simhash.near_duplicates(docs, errors=0, percent=percent).select("doc_id", "component_id", "fp").collect()
    root, values = wanted_groups(texts, percent), {}
    for r in sorted(found, key=lambda r: r["doc_id"]):
        first = values.setdefault(r["fp"], r["doc_id"])
        a, b = sorted((root[first], root[r["doc_id"]]))
        root = [a if x == b else x for x in root]
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: min(j for j in range(len(root)) if root[j] == root[k]) for k in range(len(root))}
    assert len(set(root)) < len(texts) - 50


def test_bitmaps_never_reject_similar_sets():
    rng = np.random.default_rng(3)
    one, two, alike = [], [], []
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 129, 500, 3000] * 4:
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate((a[rng.random(n) < rng.choice([0.95, 0.85, 0.5])], rng.integers(0, 2**64, rng.integers(0, n // 8 + 2), dtype=np.uint64)))
        if len(b):
            one.append(np.unique(a))
            two.append(np.unique(b))
            both = len(np.intersect1d(a, b))
            alike.append(180 * both >= 80 * (len(one[-1]) + len(two[-1])))
    at = np.arange(len(one))
    sizes = np.array([len(a) + len(b) for a, b in zip(one, two)])
    got = likeness.may_be_alike(likeness.Bitmaps([likeness.bitmap(a) for a in one]), at, likeness.Bitmaps([likeness.bitmap(b) for b in two]), at, sizes, 80)
    alike = np.array(alike)
    assert alike.sum() > 40 and got[alike].all() and got[~alike].mean() < 0.6
    far = likeness.Bitmaps([likeness.bitmap(rng.integers(0, 2**64, 600, dtype=np.uint64)) for _ in range(200)])
    assert not likeness.may_be_alike(far, np.arange(0, 100), far, np.arange(100, 200), np.full(100, 1200), 80).any()


def test_a_frequent_key_makes_few_pairs(spark):
    """A passage at the keys of 600 texts that aren't similar: pairs are counted before whole sets are read."""
    rng = random.Random(6)
    passage = prose(rng, 12)
    texts = [passage + " " + " ".join(prose(rng, 60).split()[:rng.randint(20, 50)]) for _ in range(600)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    rows = docs.select(*likeness.row_key(F.col("doc_id"), F.col("text")), "text")
    keyed = likeness._keyed(rows, 80, 5)
    nodes = keyed.select("sig", "n", "keys", "bits").cache()
    posted = nodes.select("sig", "n", F.posexplode("keys").alias("pos", "key")).withColumn("root", F.col("sig"))
    assert likeness._among_others(posted, nodes, 80).count() < 200


def test_nothing_similar_and_no_rows(make_docs, no_docs, rng):
    docs = make_docs([(n, prose(rng, 40)) for n in range(12)] + [(20, None), (21, " ")])
    found = simhash.near_duplicates(docs, errors=0, percent=80).collect()
    assert Counter(r["component_id"] for r in found) == Counter([*range(12), 20, 20])
    assert simhash.near_duplicates(no_docs, percent=80).collect() == []
