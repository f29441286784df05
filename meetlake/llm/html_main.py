"""Main text of web pages by a tree-structured graphical model.

Every block element of a page and every text run below one is a node with a hidden state: content or not. A node's own
potential comes from its features (tag, words of class and id, length, share of links, punctuation), and a parent-child
potential ties it to its parent. Both are log ratios of counts over labelled pages. Sum-product messages go up the tree and
down again and give each text run's exact marginal; runs that are more likely content than not are the text.

Labels come from pages that mark their article themselves (``labelled``). The counts are a small table of features,
whatever the corpus; they are summed by Spark over about ``sample`` pages at most, those with a small hash of their id.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.shared import bounded, table

SAMPLE = 4000

#: fixed values of the markup language
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
#: An element that ends with the start of another of its kind, and what it may not reach out of.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"})}
#: Words of tags, classes, ids and roles that name what surrounds an article, and what holds one.
AROUND = frozenset(
    "ad ads advert advertisement aside banner bar breadcrumb breadcrumbs button byline comment comments cookie cookies disclaimer "
    "footer form header login masthead menu nav navbar navigation newsletter notice pager pagination popup promo related reply "
    "search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
HOLDER = frozenset("article body content entry main post story text".split())
NEVER = frozenset("button form input select textarea".split())
#: Containers that say nothing by themselves.
NEUTRAL = frozenset("center dd div dl dt li ol section table tbody td tfoot th thead tr ul".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile("[>\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("parent", "tag", "marks", "text", "link", "features", "up")

    def __init__(self, parent: int, tag: str, marks: frozenset, text: str | None = None, link: int = 0):
        self.parent, self.tag, self.marks, self.text, self.link = parent, tag, marks, text, link


def _marks(attributes: str) -> frozenset:
    if "=" not in attributes:
        return frozenset()
    return frozenset(w for found in _NAMES.findall(attributes) for w in _WORD.findall("".join(found).lower()))


class TagEnds:
    """Where tags end: at the first ``>`` outside of quoted values. Every special sign of a page is looked at once."""

    def __init__(self, html: str):
        self.html, self.known, self.span = html, {}, (0, -1, -1)
        self.last = {q: html.rfind(q) for q in "\"'"}

    def special(self, at: int) -> int:
        """The next quote or ``>`` from a place on, or -1."""
        low, high, found = self.span
        if not low <= at <= high:
            match = _SPECIAL.search(self.html, at)
            found = match.start() if match else -1
            self.span = at, found if match else len(self.html), found
        return found

    def after(self, at: int) -> int:
        """The ``>`` that ends a tag whose attributes begin at a place; -1 if there is none or a quote stays open."""
        passed, place = [], self.special(at)
        while place not in self.known:
            if place < 0 or self.html[place] == ">":
                self.known[place] = place
            elif place == self.last[self.html[place]]:
                self.known[place] = -1
            else:
                passed.append(place)
                place = self.special(self.html.find(self.html[place], place + 1) + 1)
        end = self.known[place]
        for p in passed:
            self.known[p] = end
        return end


def tree(html: str) -> list[Node]:
    """Block elements and text runs in page order; a node's parent comes before it. Open ends close with their parent.

    The time is linear in the page: ends of tags are found once, and open elements are looked up by name.
    """
    nodes = [Node(-1, "page", frozenset())]
    stack: list[tuple[str, int]] = [("page", 0)]  # open elements, inline ones with the node that they lie in
    where: dict[str, list[int]] = {}  # of each name the places of its open elements in the stack, ascending
    blocks, solid = [0], [0]  # the places of open elements that aren't inline, and of those that aren't paragraphs either
    run: list[str] = []
    linked, in_link = 0, 0
    ends = TagEnds(html)

    def flush():
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                nodes.append(Node(stack[-1][1], "#text", frozenset(), text, linked))
            run.clear()
        linked = 0

    def push(tag: str, node: int):
        where.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
            if tag != "p":
                solid.append(len(stack))
        stack.append((tag, node))

    def pop() -> str:
        tag = stack.pop()[0]
        where[tag].pop()
        for places in (blocks, solid):
            if places[-1] == len(stack):
                places.pop()
        return tag

    def close(at: int):
        """End the element at a place and all in it; a block among them ends the text run."""
        nonlocal in_link
        if blocks[-1] >= at:
            flush()
        while len(stack) > at:
            in_link -= pop() == "a"

    def lowest(names, above: int) -> int | None:
        """The lowest open element of some names above a place."""
        found = [places[k] for name in names if (places := where.get(name)) and (k := bisect_right(places, above)) < len(places)]
        return min(found, default=None)

    def say(text: str):
        nonlocal linked
        run.append(text)
        linked += len(text) * bool(in_link)

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            say(html[at:])
            break
        if start > at:
            say(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        match = _OPEN.match(html, start)
        end = ends.after(match.end()) if match else -1
        if end < 0:
            if html[start + 1:start + 2] in ("!", "?", "/"):
                end = html.find(">", start + 2)
                at = end + 1 if end >= 0 else size
            else:  # a sign like others
                say("<")
                at = start + 1
            continue
        at, tag = end + 1, match[2].lower()
        if match[1]:
            places = where.get(tag)
            if places and not (tag in INLINE and blocks[-1] > places[-1]):  # an inline end does not close blocks
                close(places[-1])
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img"):
                run.append(" " if tag != "wbr" else "")
            else:
                flush()
            continue
        if tag in RAW:
            last = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
            end = html.find(">", last.end()) if last else -1
            at = end + 1 if end >= 0 else size
            continue
        if tag in INLINE:
            push(tag, stack[-1][1])
            in_link += tag == "a"
            continue
        flush()
        # a block ends open paragraphs; a list item, cell or row also its siblings, but not beyond their container
        if tag in SIBLINGS:
            same, holders = SIBLINGS[tag]
            first = lowest(("p", *same), max((where[h][-1] for h in holders if where.get(h)), default=0))
        else:
            first = lowest(("p",), solid[-1])
        if first is not None:
            close(first)
        while len(stack) > 1 and stack[-1][0] in INLINE:  # open formatting doesn't take in blocks
            in_link -= pop() == "a"
        marks = _marks(html[match.end():end])
        nodes.append(Node(stack[-1][1], tag, marks))
        push(tag, len(nodes) - 1)
    flush()
    return nodes


def surrounds(node: Node) -> bool:
    return node.tag in AROUND or node.tag not in ("article", "main") and bool(node.marks & AROUND)


def _bucket(n: float) -> int:
    return min(7, int(math.log2(n + 1) / 1.5))


def set_features(nodes: list[Node]) -> None:
    for node in nodes:
        if node.tag == "#text":
            text, size = node.text, len(node.text)
            parent = nodes[node.parent].tag
            place = () if parent in NEUTRAL else ("in:" + parent,)
            node.features = (*place, f"len:{_bucket(size)}", f"link:{round(4 * min(1.0, node.link / size))}",
                             f"stop:{text[-1] in '.!?:'}", f"commas:{min(3, text.count(', '))}")
        else:
            around, holds = surrounds(node), bool(node.marks & HOLDER) or node.tag in HOLDER and node.tag != "body"
            name = () if node.tag in NEUTRAL else ("tag:" + node.tag,)
            node.features = (*name, f"around:{around}", f"holds:{holds and not around}")


def truth(nodes: list[Node]) -> list[bool]:
    """What an article's own markup says: inside article or main, and inside nothing that surrounds articles."""
    inside, out = [], []
    for node in nodes:
        above = inside[node.parent] if node.parent >= 0 else None
        if above is False or surrounds(node) or node.tag in NEVER:
            state = False
        elif node.tag in ("article", "main"):
            state = True
        else:
            state = above
        inside.append(state)
        out.append(state is True)
    return out


def kind(node: Node) -> str:
    """Which parent-child potential a node has: text, elements that may begin an article, and all others."""
    return "text" if node.tag == "#text" else "holder" if "holds:True" in node.features else "block"


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, tuple[int, int]]:
    """Counts of every feature and every parent-child pair by state, over pages that mark their article."""
    marked = pages.where(F.lower(html_col).rlike("<(article|main)[ >]"))
    labelled = bounded(marked, sample, id_col, html_col).select(F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for html in batch.column("html"):
                nodes = tree(html.as_py())
                set_features(nodes)
                states = truth(nodes)
                for node, state in zip(nodes, states):
                    for feature in node.features:
                        seen[feature, state] += 1
                    seen["all:" + kind(node), state] += 1
                    if node.parent >= 0:
                        seen[f"pair:{kind(node)}:{int(states[node.parent])}", state] += 1
        names = [k for k, _ in seen]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([s for _, s in seen], pa.bool_()),
                                          pa.array(list(seen.values()), pa.int64())], ["name", "state", "n"])

    sums = labelled.mapInArrow(run, "name string, state boolean, n bigint").groupBy("name").agg(
        F.sum(F.when(~F.col("state"), F.col("n")).otherwise(0)).alias("no"),
        F.sum(F.when(F.col("state"), F.col("n")).otherwise(0)).alias("yes"))
    return {r["name"]: (r["no"], r["yes"]) for r in sums.collect()}  # tags, words of lists and buckets: no more with more pages


class Model:
    """Log potentials from counts, and exact marginals of a page's nodes."""

    SMOOTH = 0.5
    #: A text run's features overlap (short ones rarely end a sentence), so each counts for a part. What no labelled page has
    #: is no proof: ratios end at LIMIT. The names that surround articles are knowledge beyond the labels: at least AROUND.
    TEXT_PART, LIMIT, AROUND = 0.4, 3.0, -10.0

    def __init__(self, counts: dict[str, tuple[int, int]]):
        no_blocks, yes_blocks = (sum(counts.get("all:" + k, (0, 0))[i] for k in ("block", "holder")) for i in (0, 1))
        totals, s = {"text": counts.get("all:text", (0, 0)), "block": (no_blocks, yes_blocks)}, self.SMOOTH
        self.own = {}
        for name, (no, yes) in counts.items():
            what = name.split(":")[0]
            if what in ("all", "pair"):
                continue
            of_block = what in ("tag", "around", "holds")
            all_no, all_yes = totals["block" if of_block else "text"]
            ratio = math.log((yes + s) / (all_yes + 2 * s)) - math.log((no + s) / (all_no + 2 * s))
            self.own[name] = min(max(ratio, -self.LIMIT), self.LIMIT) * (1 if of_block else self.TEXT_PART)
        self.own["around:True"] = min(self.own.get("around:True", 0.0), self.AROUND)
        self.pair = {}
        for what in ("text", "block", "holder"):
            rows = []
            for state in (0, 1):
                no, yes = counts.get(f"pair:{what}:{state}", (0, 0))
                rows.append(tuple((n + s) / (no + yes + 2 * s) for n in (no, yes)))
            self.pair[what] = rows
        self.own["tag:page"] = -8.0  # the page as a whole is never an article

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that a node is content, by one pass of messages up the tree and one down."""
        own = self.own
        up = [sum(own.get(f, 0.0) for f in node.features) for node in nodes]
        message = [0.0] * len(nodes)

        def through(log_odds: float, one: float, other: float) -> float:
            """log (one * odds + 1 - one) / (other * odds + 1 - other), for the chances of content below either state."""
            odds = math.exp(min(max(log_odds, -60.0), 60.0))
            return math.log((one * odds + 1 - one) / (other * odds + 1 - other))

        table_ = {k: (p[1][1], p[0][1]) for k, p in self.pair.items()}
        for k in range(len(nodes) - 1, 0, -1):
            one, other = table_[kind(nodes[k])]
            message[k] = through(up[k], one, other)
            up[nodes[k].parent] += message[k]
        out = [up[0]] + [0.0] * (len(nodes) - 1)
        for k in range(1, len(nodes)):
            # the parent's belief without this child, sent down by its chances of content below content and below none
            above = out[nodes[k].parent] - message[k]
            one, other = table_[kind(nodes[k])]
            odds = math.exp(min(max(above, -60.0), 60.0))
            out[k] = up[k] + math.log((odds * one + other) / (odds * (1 - one) + 1 - other))
        return [1 / (1 + math.exp(-min(max(x, -60.0), 60.0))) for x in out]


def main_text(model: Model, html: str) -> str:
    nodes = tree(html)
    if len(nodes) == 1:
        return ""
    set_features(nodes)
    return "\n".join(node.text for node, p in zip(nodes, model.marginals(nodes)) if node.text is not None and p > 0.5)


def extracted(pages: DataFrame, counts: dict[str, tuple[int, int]], html_col: str = "html") -> DataFrame:
    """The rows with text (blocks joined by one line feed; empty if there are none) and n_chars, its code points.

    Null and empty pages have an empty text. Unclosed and crossing elements, comments, character references and raw
    elements are treated as browsers do, as far as text runs depend on it. All columns are kept but the html; columns
    named text or n_chars are replaced.
    """
    sent = pages.sparkSession.sparkContext.broadcast(counts)
    rest = [f for f in pages.schema if f.name not in (html_col, "text", "n_chars")]
    rows = pages.select(F.struct(*(F.col(f"`{f.name}`") for f in rest)).alias("rest") if rest else F.lit(0).alias("rest"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value)
        for batch in batches:
            texts = [main_text(model, h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], ["rest", "text"])

    out = rows.mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, text string")
    return out.select(*([F.col("rest.*")] if rest else []), "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, train(pages))
