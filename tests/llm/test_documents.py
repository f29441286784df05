"""Fingerprints, quality, mixing and encoding of documents, against brute force."""

import base64
import hashlib
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meetlake.llm import bpe, mixing, quality_classifier, quality_rules, simhash
from meetlake.llm.components import components
from tests.llm import brute
from tests.llm.conftest import prose


# --- near duplicates ---------------------------------------------------------------------------------------------

def test_fingerprints_and_components(odd_docs, odd_texts):
    got = simhash.near_duplicates(odd_docs).select("doc_id", F.lower(F.hex("fp")).alias("fp"), "component_id", "n_linked").collect()
    values = [brute.simhash(t) for _, t in odd_texts]
    groups = brute.groups([10**6 if i is None else i for i, _ in odd_texts], values)
    expected = Counter((i, format(v, "x"), groups[10**6 if i is None else i]) for (i, _), v in zip(odd_texts, values))
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in got) == expected
    assert {r["doc_id"]: r["n_linked"] for r in got}[1] == 3


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    values = np.concatenate([centres, *(c ^ (np.uint64(1) << rng.integers(0, 64, 25, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 25, dtype=np.uint64)) for c in centres)])
    left, right = np.unique(values[:600]), np.unique(values[500:])
    for one, two in ((left, right), (left, left)):
        a = simhash.Trie(one)
        b = a if two is one else simhash.Trie(two)
        got = sorted((int(i), int(j)) for x, y in simhash.linked(a, b, 4) for i, j in zip(x, y))
        near = np.bitwise_count(one[:, None] ^ two[None, :]) <= 4
        expected = [(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if two is not one or i < j]
        assert got == expected


def test_hot_prefix(spark, monkeypatch):
    """Blocks under one prefix are split, and links across the pieces are kept."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(2)
    values = np.unique(np.concatenate([rng.integers(0, 2**40, 150, dtype=np.uint64), rng.integers(0, 2**64, 60, dtype=np.uint64)]))
    values = np.unique(np.concatenate([values, values[::3] ^ np.uint64(9), values[::5] ^ np.uint64(1 << 63)]))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.trie_links(nodes)).collect()}
    groups = brute.groups(list(range(len(values))), [int(v) for v in values])
    found = {}
    for n, v in enumerate(values.view(np.int64).tolist()):
        found.setdefault(roots.get(v, v), set()).add(groups[n])
    assert all(len(g) == 1 for g in found.values()) and len(found) == len(set(groups.values()))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_one_of_each_group_stays(odd_docs, odd_texts):
    rows = simhash.one_of_each(odd_docs)
    assert rows.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in rows.collect())
    values = [brute.simhash(t) for _, t in odd_texts]
    rank = sorted(range(len(odd_texts)), key=lambda n: (odd_texts[n][0] is None, odd_texts[n][0] or 0))
    groups = brute.groups(list(range(len(rank))), [values[n] for n in rank])
    assert ids == Counter(odd_texts[rank[g]][0] for g in set(groups.values()))


def test_similar_texts_leave_one(make_docs, rng):
    """Planted near copies far beyond 4 bits, against the sets of five words of all pairs."""
    import corpus_pipeline
    pairs = []
    for n in range(12):
        base = prose(rng, rng.randint(60, 260)).split()
        for k in range(6):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(len(words))] = f"other{rng.randrange(10**9)}"
            pairs.append((100 * n + k, " ".join(words).upper() if k == 1 else " \n".join(words)))
    pairs += [(5000, None), (5001, ""), (5002, "a b"), (5003, "A  b"), (5004, prose(rng, 300))]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in pairs]
    values = [brute.simhash(t) for _, t in pairs]
    root = list(range(len(pairs)))
    far = 0
    for i in range(len(pairs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            similar = union > 0 and 5 * len(sets[i] & sets[j]) >= 4 * union
            far += similar and (values[i] ^ values[j]).bit_count() > 4
            if similar or (values[i] ^ values[j]).bit_count() <= 4:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert far > 20
    got = corpus_pipeline.simhash_near_dedup(None, make_docs(pairs), "").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(pairs[r][0] for r in set(root))


# --- quality rules -----------------------------------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if grams[tuple(words[k:k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def test_base_counts(make_docs, odd_texts):
    pairs = odd_texts + [(50, "a\nb\n\na\n \n \nb # c"), (51, " \n \nx y | <>"), (52, "é" * 30 + " ü" * 40)]
    got = quality_rules.judged(make_docs(pairs)).select("doc_id", *quality_rules._COUNTS, "base_failed", "kept").collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter((i, *brute_counts(t)) for i, t in pairs)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_outliers_go_and_clean_documents_stay(make_docs, rng):
    clean = [(n, " ".join(prose(rng, rng.randint(30, 400)).split())) for n in range(420)]
    noisy = [(1000 + n, " ".join(w + "###" for w in prose(rng, 100).split())) for n in range(25)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(make_docs(clean + noisy)).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in noisy)
    assert quality_rules.kept_documents(make_docs(clean + noisy)).count() == len(clean)


def test_estimate_is_that_of_the_closest(spark):
    """Against concentration steps over arrays, with the same start and share."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, [1, .2, .1, .1, .3], (400, 5))
    x[:60] += [0, 5, 5, 0, 0]
    frame = spark.createDataFrame([("l", "s", *map(float, r)) for r in x], "lang_group string, source_group string, " + ", ".join(f"{n} double" for n in quality_rules._NAMES))
    got = quality_rules.estimates(frame).first()
    q = np.quantile(x, [.25, .5, .75], axis=0, method="inverted_cdf")
    centre, scatter = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)
    ridge = np.diag(np.square(list(quality_rules.FLOORS.values())))
    for _ in range(quality_rules.STEPS):
        gap = x - centre
        d2 = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(scatter + ridge), gap)
        near = x[d2 <= np.quantile(d2, quality_rules.SHARE, method="inverted_cdf")]
        centre, scatter = near.mean(axis=0), np.cov(near.T, bias=True) * quality_rules.CONSISTENCY
    assert np.allclose(got["centre"], centre, atol=1e-6)
    assert np.allclose(got["inverse"], np.linalg.inv(scatter + ridge).ravel(), rtol=1e-5, atol=1e-6)


def group_of(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source) for i, t in texts], "doc_id bigint, text string, lang string, source string")


def test_outliers_in_one_statistic_go(spark, rng):
    words = lambda n, low, high: ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(low, high))) for _ in range(n)]
    lines = lambda w, k=10: "\n".join(" ".join(w[i:i + k]) for i in range(0, len(w), k))
    clean = [(n, lines(words(rng.randint(80, 300), 3, 7))) for n in range(300)]
    many = words(150, 3, 7)
    short = [" ".join(words(5, 3, 7)) for _ in range(10)]
    odd = {
        1001: lines(words(60_000, 3, 7)), 1002: lines(words(150, 14, 18)), 1003: lines([w + "#" * (k % 3 == 0) for k, w in enumerate(many)]),
        # two thirds of the lines are copies, in an order in which hardly eight words repeat
        1004: "\n".join(short[(k * k + k // 10) % 10] for k in range(10)) + "\n" + "\n".join(" ".join(words(5, 3, 7)) + "\n-" for _ in range(20)),
        1005: lines(many + many[:20], 9)}
    got = quality_rules.judged(group_of(spark, clean + list(odd.items()))).collect()
    assert not any(r["base_failed"] for r in got)
    assert {r["doc_id"] for r in got if not r["kept"]} == set(odd)


def test_two_fifths_of_junk_go(spark, rng):
    clean = [(n, " ".join(prose(rng, rng.randint(60, 300)).split())) for n in range(120)]
    noisy = [(1000 + n, " ".join(w + "###" for w in prose(rng, rng.randint(60, 300)).split())) for n in range(80)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(group_of(spark, clean + noisy)).collect()}
    assert {i for i, k in got.items() if k} == {i for i, _ in clean}


def test_small_groups_get_verdicts(spark, rng):
    """Junk of a rare language and of a rare source goes, their clean documents stay."""
    text = lambda junk=False: " ".join(w + "###" * junk for w in prose(rng, rng.randint(60, 300)).split())
    docs = group_of(spark, [(n, text()) for n in range(150)]).unionByName(
        group_of(spark, [(1000 + n, text(n == 0)) for n in range(12)], "rare", "s")).unionByName(
        group_of(spark, [(2000 + n, text(n == 0)) for n in range(7)], "en", "small"))
    got = quality_rules.judged(docs).collect()
    assert all(r["distance"] is not None for r in got)
    assert {r["doc_id"] for r in got if not r["kept"]} == {1000, 2000}


# --- quality classifier ------------------------------------------------------------------------------------------

def test_classifier_learns_and_scores_all(spark, make_docs, rng):
    good = [(n, prose(rng, rng.randint(5, 80))) for n in range(120)]
    bad = [(1000 + n, " ".join(w.upper() + "!!" for w in prose(rng, rng.randint(5, 80)).split())) for n in range(60)]
    docs = make_docs(good + bad + [(5000, None), (5001, ""), (5002, prose(rng, 9000))])
    rows = docs.where("doc_id < 5000 and doc_id % 4 <> 0").select(
        F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") < 1000, 1).otherwise(0).alias("label"))
    model = quality_classifier.train(rows.unionByName(rows.limit(1).withColumn("label", F.lit(None).cast("int"))))
    again = quality_classifier.train(rows.repartition(7))
    assert np.array_equal(model[0], again[0])
    out = quality_classifier.scored(docs, model).collect()
    assert len(out) == 183 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"]: r["predicted"] for r in out if r["doc_id"] < 5000 and r["doc_id"] % 4 == 0} == {
        i: int(i < 1000) for i, _ in good + bad if i % 4 == 0}
    scores = {r["doc_id"]: r["score"] for r in out}
    assert scores[5000] == scores[5001]


def test_classifier_margin_is_the_dot_product(rng):
    texts = [prose(rng, 40), "", "one", "two words"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    weights = np.random.default_rng(1).normal(size=1 << quality_classifier.BITS)
    got = quality_classifier.margins(weights, 0.5, data, offsets)
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        own = 0.5 + sum(quality_classifier.FAMILY * weights[p[f[0]:f[0] + s[0]]].mean() for p, f, s in
                        quality_classifier.features(raw, np.array([0, len(raw)])) if s[0])
        assert abs(got[k] - own) < 1e-9


def test_classifier_without_both_labels(make_docs, no_docs):
    docs = make_docs([(1, "a b c")])
    model = quality_classifier.train(docs.select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("label")))
    assert [r["score"] for r in quality_classifier.scored(docs, model).collect()] == [0.5]
    empty = quality_classifier.train(no_docs.select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("label")))
    assert quality_classifier.scored(no_docs, empty).count() == 0


# --- mixing ------------------------------------------------------------------------------------------------------

def test_raking_meets_all_margins(spark):
    rows = [(f"s{a}", f"l{b}", f"t{c}", 10 + 7 * a + 3 * b * c + 11 * (a == b)) for a in range(3) for b in range(2) for c in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    targets = {"source": {"s0": 2, "s1": 1, "s2": 1}, "lang": {"l0": 1, "l1": 3}, "topic": 0.0}
    got = mixing.raked(cells, targets, sweeps=30, tolerance=1e-9).collect()
    want = {"source": {"s0": .5, "s1": .25, "s2": .25}, "lang": {"l0": .25, "l1": .75}, "topic": dict.fromkeys(["t0", "t1", "t2"], 1 / 3)}
    fitted = np.array([r["tokens"] for r in sorted(got)], float)
    order = sorted(got)
    for _ in range(200):
        for m, w in want.items():
            for name, share in w.items():
                at = [k for k, r in enumerate(order) if r[m] == name]
                fitted[at] *= share / fitted[at].sum()
    assert np.allclose([r["fitted"] for r in order], fitted, atol=1e-7)


def test_plans_of_a_fit_do_not_grow_with_the_margins(spark, monkeypatch):
    """Each scaling of a margin reads the cells twice; it is written, so that the next one doesn't do so again."""
    joins, write = [], mixing.staged

    def staged(df, name):
        if name == "cells":
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, name)

    monkeypatch.setattr(mixing, "staged", staged)
    cells = spark.createDataFrame([(f"s{k % 3}", f"l{k % 2}", f"t{k % 5}", 10 + k * k) for k in range(30)],
                                  "source string, lang string, topic string, tokens bigint")
    found = mixing.raked(cells, mixing.TEMPER).collect()
    assert len(found) == 30 and max(r["margin_gap"] for r in found) <= mixing.TOLERANCE
    assert max(joins) <= 2 and len(joins) % 3 == 0


def test_mixture_is_calibrated(make_docs, rng):
    docs = make_docs([(n, prose(rng, rng.randint(1, 120))) for n in range(400)] + [(900, None), (901, ""), (5, "x")])
    rows = mixing.mixture(docs, budget=0.4).collect()
    assert len(rows) == 403
    tokens = sum(r["n_tokens"] for r in rows)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in rows) / tokens - 0.4) < 1e-6
    assert all(0 <= r["probability"] <= 1 for r in rows) and not any(r["sampled"] for r in rows if r["doc_id"] in (900, 901))
    drawn = mixing.sampled_documents(docs, budget=0.4)
    assert drawn.columns == docs.columns
    assert Counter(r["doc_id"] for r in drawn.collect()) == Counter(r["doc_id"] for r in rows if r["sampled"])
    everything = mixing.mixture(docs, budget=1.0)
    assert everything.where("n_tokens > 0 and not sampled").count() == 0


def test_mixture_of_nothing(no_docs):
    assert mixing.mixture(no_docs).count() == 0


# --- encoding ----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding(odd_docs, odd_texts, library):
    out = bpe.encoded(odd_docs, *bpe.local_ranks(), decoded=True)
    assert set(odd_docs.columns) - {"text"} < set(out.columns)
    got = Counter((r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), bytes(r["decoded"])) for r in out.collect())
    expected = Counter()
    for i, t in odd_texts:
        ids = library.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), (t or "").encode()] += 1
    assert got == expected


def test_pieces_of_long_texts(library, rng):
    for text in (prose(rng, 3000), "it's  we'll 's \n\n x  y z 12 ab" * 300, " " * 5000 + "a" * 5000, "語" * 3000):
        for size in (1, 10, 500):
            assert bpe.encode(library, text, size).tolist() == library.encode_ordinary(text)


def test_encoding_of_nothing(no_docs):
    assert bpe.encoded(no_docs, *bpe.local_ranks()).count() == 0
