"""Web pages of result archives: year links, competition blocks and the source rows they give."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.functions.text import squash
from meetlake.operators.documents import KIND, KIND_EXCLUDED, is_wanted

ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)</a>"
ANCHOR_WHOLE = r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)[^>]*>.*?</a>"
# fixed values: the named character references resolved in link texts and targets
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLIMB = 6


def plain_text(html: Column) -> Column:
    """Text of an HTML fragment: tags become blanks, common references their characters."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for code, char in ENTITIES.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return squash(out)


def absolute_url(base: str, href: Column) -> Column:
    """Resolve a link against a site root such as https://host."""
    root = base.rstrip("/")
    scheme = root.split(":", 1)[0]
    clean = F.regexp_replace(href, r"^(?:\.{1,2}/)+", "")
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href))
            .when(href.startswith("/"), F.concat(F.lit(root), href))
            .when((href == "") | href.rlike("^[#?]"), F.concat(F.lit(root), href))
            .otherwise(F.concat(F.lit(root + "/"), clean)))


def page_links(pages: DataFrame, base: str, page: str = "page_id", html: str = "html") -> DataFrame:
    """All links of each page in order: position, label and absolute url."""
    links = pages.select(page, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(ANCHOR_WHOLE), 0)).alias("position", "a"))
    href = F.concat(*[F.regexp_extract("a", ANCHOR, i) for i in (1, 2, 3)])
    for code, char in ENTITIES.items():
        href = F.replace(href, F.lit(code), F.lit(char))
    return links.select(page, "position", plain_text(F.regexp_extract("a", ANCHOR, 4)).alias("label"),
                        absolute_url(base, F.trim(href)).alias("url"))


def labelled_links(pages: DataFrame, base: str, label_pattern: str = r"^\d{4}$", page: str = "page_id",
                   html: str = "html") -> DataFrame:
    """Links whose label matches, once per page and url; a repeated url keeps its last label.

    All links of a page come out of one row, so the grouping is done before anything is shuffled.
    """
    found = page_links(pages, base, page, html).where(F.col("label").rlike(label_pattern))
    return found.groupBy(page, "url").agg(F.max_by("label", "position").alias("label"))


def keyword_flags(names: DataFrame, name: str, kind: str = KIND, excluded: Sequence[str] = KIND_EXCLUDED) -> DataFrame:
    return names.withColumn("wanted", is_wanted(F.col(name), kind, excluded))


class _BlockFinder(HTMLParser):
    """For each wanted text, the first wanted link inside the nearest enclosing element (six levels)."""

    def __init__(self, text_has: str, label: str):
        super().__init__(convert_charrefs=True)
        self.text_has, self.label = text_has, label
        self.parents, self.first = [-1], [None]  # per element: parent, first wanted link below it
        self.tags, self.open = [""], [0]
        self.links, self.texts = [], []  # links being read: [element, href, label parts]

    def handle_starttag(self, tag, attrs):
        me = len(self.parents)
        self.parents.append(self.open[-1])
        self.first.append(None)
        self.tags.append(tag)
        href = dict(attrs).get("href")
        if tag == "a" and href is not None:
            self.links.append([me, href.strip(), []])
        if tag not in VOID_TAGS:
            self.open.append(me)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[depth]] == tag:
                closed = set(self.open[depth:])
                del self.open[depth:]
                for link in [x for x in self.links if x[0] in closed]:
                    self._finish(link)
                return

    def handle_data(self, data):
        for link in self.links:
            link[2].append(data.strip())
        if self.text_has in data and data.strip():
            self.texts.append((self.open[-1], data.strip()))

    def _finish(self, link):
        self.links.remove(link)
        label = " ".join(p for p in link[2] if p).lower()
        up = self.parents[link[0]]
        while label == self.label and up >= 0 and self.first[up] is None:
            self.first[up] = link[1]
            up = self.parents[up]

    def blocks(self):
        for link in list(self.links):
            self._finish(link)
        for element, text in self.texts:
            for _ in range(CLIMB):
                if element < 0:
                    break
                if self.first[element] is not None:
                    yield text, self.first[element]
                    break
                element = self.parents[element]


def competition_blocks(pages: DataFrame, base: str, text_has: str = "Powerlifting", label: str = "men",
                       kind: str = KIND, excluded: Sequence[str] = KIND_EXCLUDED, page: str = "page_id",
                       html: str = "html") -> DataFrame:
    """Competition names with the first link labelled ``label`` near them, once per page, name and url.

    Climbing from a text to its enclosing elements needs the element tree, which only a parser gives;
    each page is parsed where it lies and yields its few blocks.
    """
    kind_of = pages.schema[page].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch[page], batch[html], strict=True):
                finder = _BlockFinder(text_has, label)
                finder.feed(text or "")
                finder.close()
                rows.extend((key, name, href) for name, href in finder.blocks())
            yield pd.DataFrame(rows, columns=[page, "competition", "href"])

    found = pages.select(page, html).mapInPandas(find, f"{page} {kind_of}, competition string, href string")
    return found.where(is_wanted(F.col("competition"), kind, excluded)).select(
        page, "competition", absolute_url(base, F.col("href")).alias("men_url")).distinct()


def source_rows(year_links: DataFrame, pages: DataFrame, blocks: DataFrame, page: str = "page_id",
                url: str = "url") -> DataFrame:
    """The competition blocks of the pages that the year links lead to, as source rows awaiting verification."""
    behind = year_links.select(F.col("label").alias("year"), F.col("url").alias("_to")).join(
        pages.select(page, F.col(url).alias("_to")), "_to")
    return behind.join(blocks, page).select(
        "year", "competition", "men_url", F.lit("NEEDS_VERIFICATION").alias("status"))
