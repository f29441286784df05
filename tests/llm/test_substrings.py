"""Repeated windows of words and bytes, against brute force."""

import random

import numpy as np
import pytest

from meetlake.llm import seeds, suffix_dedup, window_dedup
from tests.llm import brute
from tests.llm.conftest import prose


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)



def brute_words(pairs, window=35):
    return [(pairs[n][0], *rest) for n, *rest in brute.cut_words(list(enumerate(t for _, t in pairs)), window)]


def brute_bytes(pairs, window=200):
    return [(pairs[n][0], *rest) for n, *rest in brute.cut_bytes(list(enumerate(t for _, t in pairs)), window)]


def test_words(odd_docs, odd_texts):
    got = window_dedup.repeated_words(odd_docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(got, brute_words(odd_texts))


def test_bytes(odd_docs, odd_texts):
    got = suffix_dedup.repeated_bytes(odd_docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(got, brute_bytes(odd_texts))


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(make_docs, seed):
    """Texts of few different words repeat at every length, so all levels and all edges between buckets are met."""
    rng = random.Random(seed)
    pairs = [(n, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for n in range(60)]
    docs = make_docs(pairs)
    same(window_dedup.repeated_words(docs, window=9, seed=2).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(),
         brute_words(pairs, 9))
    same(suffix_dedup.repeated_bytes(docs, window=24, seed=9).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute_bytes(pairs, 24))


def test_hot_passage(make_docs):
    """A passage in a third of the documents, with different surroundings each time."""
    rng = random.Random(5)
    passage = prose(rng, 50)
    pairs = [(n, prose(rng, rng.randint(0, 30)) + (passage if n % 3 == 0 else "") + prose(rng, rng.randint(0, 30))) for n in range(90)]
    same(window_dedup.repeated_words(make_docs(pairs)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(),
         brute_words(pairs))
    same(suffix_dedup.repeated_bytes(make_docs(pairs)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(),
         brute_bytes(pairs))


def test_documents_keep_their_columns(odd_docs, odd_texts):
    out = window_dedup.without_repeated_words(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert len(rows) == len(odd_texts)
    removed = {i: g for i, _, g, _ in brute_words(odd_texts)}
    for row in rows:
        if row["doc_id"] in (7, 8, 9, 19):
            assert len(brute.words(row["text"])) == len(brute.words(dict(odd_texts)[row["doc_id"]])) - removed[row["doc_id"]]
    kept = {r["doc_id"]: r["text"] for r in rows}
    assert kept[1] is None and kept[2] == "" and kept[3] == " \n\t" and kept[4] == "" and kept[19] == dict(odd_texts)[19]


@pytest.mark.parametrize("ids", ["own", "null", "one"])
def test_copies_under_one_key(make_docs, ids):
    """Rows that repeat an id and text, or a text without an id: the same result, and lists that don't grow with the copies."""
    rng = random.Random(9)
    text, other = prose(rng, 120), prose(rng, 80)
    pairs = [({"own": n, "null": None, "one": 5}[ids], text) for n in range(40)] + [(100, other + text[:400]), (101, other)]
    docs = make_docs(pairs)
    same(window_dedup.repeated_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute_words(pairs))
    same(suffix_dedup.repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute_bytes(pairs))
    scanned = seeds.scan(docs, "doc_id", "text", "word", 35, 9, doubled=True)
    live = window_dedup._live_seeds(window_dedup._doubled(scanned))
    compared = seeds.compare_blocks(seeds.keyed_texts(docs, "doc_id", "text"), live, "word", 35, 1)
    most = max(len(r["whole_at"]) for r in compared.collect())
    assert most <= len(text.split())


def test_empty_table(no_docs):
    assert window_dedup.repeated_words(no_docs).count() == 0
    assert suffix_dedup.repeated_bytes(no_docs).count() == 0
    assert window_dedup.without_repeated_words(no_docs).columns == no_docs.columns


def test_multikey_order():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 3, 200) for _ in range(4)]
    order, group = suffix_dedup.multikey_order(keys)
    expected = np.lexsort(keys[::-1])
    rows = np.stack(keys)
    assert (rows[:, order] == rows[:, expected]).all()
    assert [len(set(map(tuple, rows[:, order[group == g]].T))) for g in range(group.max() + 1)] == [1] * (group.max() + 1)
    assert len(suffix_dedup.multikey_order([np.zeros(0, np.int64)] * 2)[0]) == 0
