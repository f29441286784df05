"""Personal data: patterns against plain regular expressions, the field against brute force, and held-out texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from meetlake.llm import pii
from tests.llm.conftest import prose

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def values(rng):
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))
    while not pii.luhn(card := digits(16)):
        pass
    return {"email": f"{rng.choice('abcdefg')}{prose(rng, 1).strip() or 'x'}.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com".replace(" x", "").translate({ord(c): "s" for c in "éíß \t\r\n"}),
            "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card,
            "phone": f"+1 ({digits(3)}) 555-{digits(4)}"}


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    odd = ["", "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8.9", "1..2.3.4.5", "256.1.1.1 1.1.1.1", "+1 (((((", "++12--345 678 90", "a@@b.c", "@b.c",
           "x@y", "é@b.co", "0007.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 22", "4111  111111111111", "1" * 40, "+" + "1" * 16, "ä+49 30 123456.",
           "9" * 6000 + ".1.1.1"]
    for _ in range(4000):
        odd.append("".join(rng.choice("0123456789.@+-() abé_%\n") for _ in range(rng.randint(1, 60))))
    for _ in range(300):
        odd.append(prose(rng, 3).join(values(rng)[k] for k in ("phone", "email", "card", "ip")))
    for text in odd:
        assert pii.base_spans(text) == [s for s in plain_base(text if len(text) < 6000 else "")] or len(text) >= 6000
    assert pii.base_spans("9" * 6000 + ".1.1.1") == []


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1." * 500_000, "+1" + "(" * 10**6, "@" * 10**5, "a@b" * 10**5, "+1 " * 10**5,
                                  "[" * 10**5, "1 " * 10**5])
def test_long_odd_texts_take_linear_time(text):
    import time
    start = time.time()
    pii.base_spans(text)
    assert time.time() - start < 3
    sum(len(run[0]) for run in pii.sequences(text, 2))
    assert time.time() - start < 6


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    rows = []
    for n in range(300):
        v = values(rng)
        text = prose(rng, 30) + " ".join(v[k] + " " + prose(rng, 12) for k in pii.KINDS)
        rows += pii.windows(text, n)
    return pii.Field.trained(rows)


def test_messages_give_the_slope_of_the_likelihood():
    """Expected less observed counts are the derivative of the log likelihood over all paths, written out."""
    rng = np.random.default_rng(0)
    names = [f"{p} {f}" for p in ("own", "before", "after") for f in ("plain", "shape 9", "digits 1")]
    f = pii.Field(names, rng.normal(size=(len(names), pii.STATES)), rng.normal(size=(pii.STATES, pii.STATES)))
    one = f.type_of(("shape 9", "digits 1"))
    types, states = np.array([[0, one, one], [one, 0, -1]]), np.array([[0, 1, 2], [3, 0, 0]])
    node, edge = f._expected(types, states, np.array([1.0, 2.0]))
    score = f.emissions(types)
    wanted, steps = np.zeros_like(node), np.zeros_like(edge)
    for r, (size, w) in enumerate(((3, 1.0), (2, 2.0))):
        paths = list(itertools.product(range(pii.STATES), repeat=size))
        value = np.array([pii._START[p[0]] + sum(score[r, t, p[t]] for t in range(size)) + sum(f.steps[a, b] for a, b in zip(p, p[1:])) for p in paths])
        share = np.exp(value - value.max())
        share /= share.sum()
        for p, s in [*zip(paths, share), (tuple(states[r, :size]), -1.0)]:
            for t in range(size):
                wanted[r, t, p[t]] += w * s
            for a, b in zip(p, p[1:]):
                steps[a, b] += w * s
    assert np.allclose(node, wanted) and np.allclose(edge, steps)


def test_viterbi_is_the_best_of_all_paths(field):
    rng = np.random.default_rng(2)
    names = [("own plain", "before plain", "after plain")]
    f = pii.Field(list(names[0]) + ["own shape 9", "before shape 9"], rng.normal(size=(5, pii.STATES)), rng.normal(size=(pii.STATES, pii.STATES)))
    one = f.type_of(("shape 9",))
    types = np.array([[0, one, 0, one, -1], [one, one, 0, 0, one], [0, -1, -1, -1, -1]])
    begins, ends = np.array([False, True, False]), np.array([True, False, False])
    got, score = f.viterbi(types, begins, ends), f.emissions(types)
    for r in range(3):
        size = int((types[r] >= 0).sum())
        best = max(itertools.product(range(pii.STATES), repeat=size), key=lambda p: (
            pii._START[p[0]] + sum(score[r, t, p[t]] for t in range(size)) + sum(f.steps[a, b] for a, b in zip(p, p[1:]))
            - 1e6 * (begins[r] and p[0] != 0) - 1e6 * (ends[r] and p[-1] != 0)))
        assert got[r, :size].tolist() == list(best)


def test_cut_sequences_decode_as_whole_texts(field):
    rng = random.Random(8)
    cut, whole = pii.Reader(field), pii.Reader(field)
    assert cut.reach is not None
    whole.reach = None
    texts = []
    for n in range(120):
        v = values(rng)
        parts = [x for k in pii.KINDS for x in (v[k], *pii.other_forms(k, v[k]), *pii.other_numbers(n))]
        texts.append("".join(prose(rng, rng.choice([0, 1, 3, 10, 11, 12, 30])) + " " + rng.choice(parts) + " " for _ in range(8)))
    none = [[] for _ in texts]
    found = cut.added(texts, none)
    assert found == whole.added(texts, none) and sum(map(len, found)) > 150


def test_held_out_values_are_found_and_clean_texts_left_alone(field):
    """Other values in other forms, recall and precision; texts with dates, prices and long numbers."""
    rng = random.Random(77)
    reader, hits, wanted, given = pii.Reader(field), 0, 0, 0
    for n in range(200):
        v = values(rng)
        text, planted = prose(rng, 20), []
        for k in pii.KINDS:
            form = rng.choice(pii.other_forms(k, v[k]))
            planted.append((k, len(text), len(text) + len(form)))
            text += form + " " + prose(rng, 15)
        base = pii.base_spans(text)
        found = set(reader.added([text], [base])[0])
        free = [p for p in planted if not any(a < p[2] and p[1] < b for _, a, b in base)]
        hits += len(found & set(free))
        wanted += len(free)
        given += len(found)
    assert hits >= 0.9 * wanted and hits >= 0.95 * given and wanted > 500
    clean = []
    for n in range(300):
        numbers = pii.other_numbers(rng.randrange(10**6))
        clean.append(prose(rng, 10) + "".join(x + " " + prose(rng, 4) for x in rng.sample(numbers, 6)) + f'token = "{hashlib.sha1(str(n).encode()).hexdigest()}"')
    assert sum(map(len, reader.added(clean, [pii.base_spans(t) for t in clean]))) <= 3


def test_rows(make_docs, odd_texts, field, rng):
    v = values(random.Random(4))
    pairs = [*odd_texts, (70, f"über {v['email']}, {v['ip']}"), (71, f"é {v['card']} and {v['phone']}."), (None, v["email"]), (72, pii.other_forms("phone", v["phone"])[0] + " x")]
    got = pii.found_spans(make_docs(pairs), field).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in pairs)
    base = sorted((str(i), plain_base(t)) for i, t in pairs)
    assert sorted((str(r["doc_id"]), [tuple(s) for s in r["base"]]) for r in got) == base
    for r in got:
        spans = [tuple(s) for s in r["spans"]]
        assert set(map(tuple, r["base"])) <= set(spans) == set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), *s[1:]))
    assert [len(r["spans"]) for r in got if r["doc_id"] == 72] == [1]


def test_training_rows_and_empty_tables(spark, make_docs, no_docs, rng):
    docs = make_docs([(n, prose(rng, 20) + values(rng)["phone"] + " " + prose(rng, 20)) for n in range(30)] + [(None, None), (1, "")])
    labelled = pii.labelled_windows(docs)
    assert {s for r in labelled.collect() for s in r["states"]} == {0, 7, 8}
    assert pii.train(labelled).settled() is not None
    nothing = pii.train(pii.labelled_windows(no_docs))
    assert pii.found_spans(no_docs, nothing).collect() == []
    rows = pii.found_spans(docs, nothing).collect()
    assert all(r["base"] == r["spans"] for r in rows) and len(rows) == 32
