"""Main text, archives and vector search, against brute force."""

import base64
import hashlib
import itertools
import math
import random
import time
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from meetlake.llm import html_main, topk, warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("text", T.StringType()), T.StructField("sha", T.StringType())])


def page(title, paragraphs, wrap=("<article>", "</article>"), end="</body></html>"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
            f'<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>'
            f'{wrap[0]}<h1>{title}</h1>{body}{wrap[1]}<footer>&copy; site &middot; All rights.</footer>{end}')


@pytest.fixture(scope="module")
def many_pages():
    rng = random.Random(9)
    sentence = lambda: " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 25))) + "."
    out = []
    for n in range(120):
        parts = [" ".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 8))]
        title = sentence()
        out.append((n, title, parts, page(title, parts, ("<article>", "</article>" if n % 3 else ""), "" if n % 5 == 0 else "</body></html>")))
    return out


@pytest.fixture(scope="module")
def counts(spark, many_pages):
    return html_main.train(spark.createDataFrame([(n, f"http://x/{n}", h, None, None) for n, _, _, h in many_pages], PAGES))


# --- main text ---------------------------------------------------------------------------------------------------

def test_articles_come_out_whole(spark, many_pages, counts):
    pages = spark.createDataFrame([(n, "u", h, "clash", "s") for n, _, _, h in many_pages] + [(900, None, None, "clash", None), (901, "u", "", None, None)], PAGES)
    got = {r["page_id"]: r for r in html_main.extracted(pages, counts).collect()}
    assert all(got[n]["text"] == "\n".join([title, *parts]) for n, title, parts, _ in many_pages)
    assert got[900]["text"] == got[901]["text"] == "" and got[900]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.mark.parametrize(("html", "expected"), [
    ("<article><h1>A&amp;B</h1><p>One <b>two</b>\n three.<br>Four &eacute;&#233; &lt;x&gt;.</p></article>", "A&B\nOne two three. Four éé <x>."),
    ("<article><p>First part.<p>Second part.<div>Third, in a block.</div>tail of it.</article>", "First part.\nSecond part.\nThird, in a block.\ntail of it."),
    ("<article><p>Kept text here.</p><form><p>Your name</p></form><aside>More links</aside><div class='comments'><p>Nice, I say.</p></div></article>", "Kept text here."),
    ("<header>Top</header><main><p>Inside of main, it says.</p></main><div id=sidebar>Side</div>", "Inside of main, it says."),
    ("<article><p>open <i>and <b>crossing</i> ends</b> here.</p><script>no()</script><!-- no --><p>Last one.", "open and crossing ends here.\nLast one."),
    ("no markup", ""), ("<", ""), ("<article>", ""), ("<article><p>  </p></article>", "")])
def test_markup(counts, html, expected):
    assert html_main.main_text(html_main.Model(counts), "<html><body><nav><a href=x>Menu</a></nav>" + html) == expected


@pytest.mark.parametrize("html", [
    "<a " * 330_000, "<b>" * 150_000 + "</i>" * 150_000, "<a " * 200_000 + '" >', "<a \"'" * 200_000, "<script>" + "</script" * 120_000,
    "<div>" * 60_000 + "<li>" * 60_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<p>" * 150_000, "<" * 700_000, "<!" * 400_000,
    "<!--" * 250_000, '<a b="' * 150_000, "<a b='\" " * 150_000, "<div class" + " " * 1_000_000 + ">", "<table>" * 40_000 + "<tr><td>" * 40_000])
def test_odd_pages_take_linear_time(html):
    start = time.time()
    html_main.tree(html)
    assert time.time() - start < 8


@pytest.mark.parametrize(("html", "expected"), [
    ("<p>a<b>c</p>d", [("p", "ac"), ("page", "d")]), ("<ul><li>x<li>y<div><li>z</ul>w", [("li", "x"), ("li", "y"), ("li", "z"), ("page", "w")]),
    ('<p title="a>b">x', [("p", "x")]), ('<p "x>y', [("page", '<p "x>y')]), ("<p>1 < 2 <b>3", [("p", "1 < 2 3")]),
    ("<div>a</i>b</div>c", [("div", "ab"), ("page", "c")]), ("<i><div>a</i>b</div>", [("div", "ab")]), ("<td>a<tr><td>b", [("td", "a"), ("td", "b")])])
def test_open_elements(html, expected):
    nodes = html_main.tree(html)
    assert [(nodes[n.parent].tag, n.text) for n in nodes if n.text is not None] == expected


def test_messages_are_exact(counts):
    """Marginals of small trees against the sum over all states."""
    model = html_main.Model(counts)
    nodes = html_main.tree("<body><div><p>Some text, in here.</p><ul><li><a href=x>a</a></li></ul></div><footer>End</footer></body>")
    html_main.set_features(nodes)
    own = [sum(model.own.get(f, 0.0) for f in n.features) for n in nodes]
    total, on = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        p = math.exp(sum(o * s for o, s in zip(own, states)))
        for k, node in enumerate(nodes[1:], 1):
            p *= model.pair[html_main.kind(node)][states[node.parent]][states[k]]
        total += p
        for k, s in enumerate(states):
            on[k] += p * s
    assert np.allclose(model.marginals(nodes), [x / total for x in on], atol=1e-9)


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGES)
    assert html_main.extracted(none, html_main.train(none)).count() == 0


# --- archives ----------------------------------------------------------------------------------------------------

def plain_archive(rows, least=0):
    first = {}
    for i, h in rows:
        payload = (h or "").encode()
        if i is not None and len(payload) >= least:
            first[payload] = min(i, first.get(payload, i))
    out = []
    for i, h in rows:
        payload = (h or "").encode()
        of = first.get(payload)
        revisit = of is not None and of != i and len(payload) >= least
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", of if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 6])
def test_archive_round_trip(spark, tmp_path, least):
    rng = random.Random(3)
    long = "é\r\n\r\nWARC/1.1 0\r\n" * 9000
    bodies = [None, "", "<p>a</p>", "<p>a</p>", long, long, "x" * 40000, "\x00\n", *("".join(rng.choice("abé\n") for _ in range(rng.randint(0, 50))) for _ in range(60))]
    rows = [(n + 5, b) for n, b in enumerate(bodies)] + [(None, "<p>a</p>"), (7, "<p>a</p>"), (None, "alone"), (3, ""), (8, "x" * 40000)]
    pages = spark.createDataFrame([(i, None if n % 9 == 0 else f"http://h/{n} \r\nX: y", b, "t", "s") for n, (i, b) in enumerate(rows)], PAGES)
    path = str(tmp_path / uuid.uuid4().hex)
    warc.write_archive(pages.repartition(3), path, least=least, segment=1000)
    out = warc.read_archive(spark, path).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == Counter(plain_archive(rows, least))
    texts = Counter((r["page_id"], bytes(r["payload"]).decode()) for r in out if r["record_type"] == "response")
    assert texts == Counter((i, b or "") for (i, b), e in zip(rows, plain_archive(rows, least)) if e[3] == "response")


def test_broken_records_are_refused():
    whole = warc.records(b"<urn:uuid:1>", b"1", b"http://x/", b"payload " * 500, None, 1000)
    raw = b"".join(r + warc.END for r in whole)
    assert len(list(warc.parse(raw))) == len(whole) > 1
    with pytest.raises(ValueError):
        list(warc.parse(raw.replace(b"Content-Length: 1000", b"Content-Length: 999", 1)))
    for size in (1, 7, 10**6):
        assert warc.dechunked(warc.chunked(b"payload " * 50, size)) == b"payload " * 50
    assert warc.dechunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_no_archive_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archive(spark.createDataFrame([], PAGES), path)
    assert warc.read_archive(spark, path).count() == 0


# --- search ------------------------------------------------------------------------------------------------------

def plain_search(vectors, k, modulus):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in rows:
        if q % modulus == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize(("n", "block"), [(7, 4096), (150, 4096), (150, 16)])
def test_search(spark, monkeypatch, n, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(n)
    vectors = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(n)]
    vectors += [(1000, [0.25] * 6), (1001, [0.25] * 6), (1002, [0.25] * 6), (2000, None), (2005, [None, 1.0]), (2010, [float("nan")] * 6),
                (2015, [float("inf")] * 6), (None, [1.0] * 6), (3000, []), (3005, [0.5, 0.5]), (3010, [3e9] * 6)]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in vectors], "vec_id bigint, embedding array<double>, score bigint, block string")
    got = topk.top_k(df, lambda c: c % 5 == 0, k=20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] != 3010 and r["vec_id"] != 3010) == [
        x for x in plain_search(vectors, 20, 5) if 3010 not in (x[0], x[2])]


def test_repeated_vectors_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0])] * 3 + [(1, [0.5, 0.5])] * 2, "vec_id bigint, embedding array<float>")
    got = topk.top_k(df, lambda c: c % 20 == 0)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2048)]
    assert topk.top_k(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_repeated_candidates_keep_their_places(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, lambda c: c % 20 == 0, scale=1.0, k=2, repeats=True).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2), (0, 2, 1, 2)]


@pytest.mark.parametrize("repeats", [False, True])
def test_repeated_queries_are_asked_once(spark, monkeypatch, repeats):
    """A query row that repeats, an id with two vectors, and a vector that a third of the rows repeat."""
    monkeypatch.setattr(topk, "CANDIDATES", 8)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = random.Random(3)
    rows = [(n, [float(rng.randint(-3, 3)) for _ in range(4)]) for n in range(30)]
    rows += [rows[0]] * 3 + [(5, [1.0, 1.0, 1.0, 1.0])] + [(31, [3.0, 2.0, 1.0, 0.0])] * 17
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = Counter(tuple(r) for r in topk.top_k(df, lambda c: c % 5 == 0, scale=1.0, k=6, repeats=repeats).collect())
    candidates = rows if repeats else sorted({(i, tuple(v)) for i, v in rows})
    wanted = Counter()
    for own, vector in {(i, tuple(v)) for i, v in rows if i % 5 == 0}:
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(vector, v)), i) for i, v in candidates if i != own)
        wanted.update((own, rank, i, -s) for rank, (s, i) in enumerate(scored[:6], 1))
    assert got == wanted


def test_rare_marked_pages_are_all_learned(spark):
    """The bound holds for marked pages, also without ids, and pages that mark nothing don't count towards it."""
    plain = [(n, f"<body><p>plain {n}</p></body>") for n in range(400)]
    marked = [(None, f"<body><article><p>marked {n}</p></article></body>") for n in range(40)]
    pages = spark.createDataFrame(plain + marked, "page_id bigint, html string")
    assert html_main.train(pages, sample=40)["tag:article"] == (0, 40)
    assert 0 < html_main.train(pages, sample=10)["tag:article"][1] < 30
