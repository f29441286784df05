"""The whole pipeline over odd rows, repeated rows and no rows, each stage against what it must do with its own input."""

import hashlib
import random
import struct

import pytest

import corpus_pipeline
from meetlake.llm.shared import staged
from tests.llm import brute
from tests.llm.conftest import prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(odd_texts):
    rng = random.Random(21)
    passage = prose(rng, 50)
    pairs = [(i, t) for i, t in odd_texts]
    for n in range(60):
        pairs.append((1000 + n, prose(rng, rng.randint(60, 160))))
    for n in range(12):
        pairs.append((2000 + n, prose(rng, 60) + passage + prose(rng, 40)))
    pairs += [pairs[-1]] * 5 + [(None, pairs[-2][1])] * 3 + [(3000, "# * $ % " * 60), (3001, None), (3001, "")]
    near = pairs[30][1].split(" ")
    near[7] = "changed"
    return [*pairs, (4000, " ".join(near))]


@pytest.fixture(scope="module")
def folder(spark, make_docs, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    make_docs(corpus).select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path


def key(row):
    return tuple(str(v) for v in row)


def test_each_stage_works_on_what_is_before_it(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = staged(stage(spark, docs, folder), name)
        after = docs.collect()
        assert docs.columns == COLUMNS and 0 < len(after) <= len(before), name
        if name == "substring_dedup":
            texts = [r["text"] for r in before]
            cut = {(n, kept) for n, _, gone, kept in brute.cut_words(list(enumerate(texts))) if gone}
            left = sorted(key(r) for n, r in enumerate(before) if n not in {n for n, _ in cut})
            assert len(after) == len(before) and set(left) <= {key(r) for r in after}
            digests = {hashlib.sha256(b" ".join(brute.words(r["text"]))).hexdigest() for r in after}
            assert cut and {d for _, d in cut} <= digests
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after if key(r) not in left)
        else:
            rows, rest = [key(r) for r in after], [key(r) for r in before]
            assert all(rest.count(r) >= rows.count(r) for r in set(rows)), name
        if name == "simhash_near_dedup":
            words = [[w.lower() for w in brute.words(r["text"])] for r in after]  # bytes: A-Z alone
            sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
            for i in range(len(sets)):
                for j in range(i):
                    assert not sets[i] & sets[j] or 5 * len(sets[i] & sets[j]) < 4 * len(sets[i] | sets[j])


def test_the_run_ends_with_tokens_of_the_drawn_texts(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and set(corpus_pipeline.run(spark, folder).columns) == {"doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"}
    from meetlake.llm import bpe
    import public_tokenizers
    import tiktoken
    import base64
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in got:
        ids = struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])
        text = library.decode_bytes(list(ids))
        assert len(ids) == r["n_tokens"] and hashlib.sha256(text).hexdigest() == r["decoded_sha256"]
        assert library.encode_ordinary(text.decode()) == list(ids)
    assert bpe.local_ranks()


def test_no_documents(spark, no_docs, tmp_path):
    no_docs.select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_names_pass_through(spark, make_docs, corpus):
    """Columns named like those that the operators use inside."""
    docs = make_docs(corpus[:40])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, ""), name)
        assert docs.columns == [*COLUMNS, "k1", "weight", "rest"]
        assert {r["k1"] for r in docs.collect()} <= {"key"}
