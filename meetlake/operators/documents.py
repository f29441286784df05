"""Raw-document jobs: content classification, format profiles and extraction facts.

A document is one cell; every check is an expression over that cell, so these jobs are single scans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.functions.text import SPACES, any_in, has, raw_lines, squash, strip

# fixed values: words that mark or rule out a kind of competition
KIND = "powerlifting"
KIND_EXCLUDED = ("bench press", "special olympics", "blind", "differently abled", "differently-abled", "disabled",
                 "disability", "para")


@dataclass(frozen=True)
class ContentTerms:
    """Term lists of the content classifier; the defaults are the fixed values for result sheets."""

    subject: Sequence[str] = (" men ", " male ", " men's ", "mens ", "men's ")
    section: str = r"\b(open|sub\s*junior|junior|senior|masters?|master\s*[1-5])\s*-\s*\d+(?:\.\d+)?\s*kg\b"
    squat: Sequence[str] = ("squat", " sq ", "sq1", "sq2", "sq3")
    bench: Sequence[str] = ("bench press", "bench", " bp ", "bp1", "bp2", "bp3")
    deadlift: Sequence[str] = ("deadlift", "dead lift", " dl ", "dl1", "dl2", "dl3")
    total: str = r"\btotal\b"
    place: str = r"\bplace\b"
    excluded: Sequence[str] = (
        "women", "female", "girls", "blind", "differently abled", "differently-abled", "disabled", "disability",
        "para powerlifting", "para-powerlifting", "special olympics")


@dataclass(frozen=True)
class FormatTerms:
    """Vocabulary of the format profile; the defaults are the fixed values for result sheets."""

    features: Mapping[str, str] = field(default_factory=lambda: {
        "has_rank": r"\brank\b", "has_name": r"\bname\b", "has_bodyweight": r"\b(bodyweight|bd\.?\s*wt|bw)\b",
        "has_squat": r"\b(sq1|sq2|sq3|squat)\b", "has_bench": r"\b(bp1|bp2|bp3|bench)\b",
        "has_deadlift": r"\b(dl1|dl2|dl3|deadlift)\b", "has_total": r"\btotal\b"})
    header_words: Sequence[str] = (
        "rank", "name", "dob", "state", "bd. wt", "bodyweight", "sq1", "sq2", "sq3", "bp1", "bp2", "bp3",
        "dl1", "dl2", "dl3", "total", "place")
    header_score: int = 4


# ---- keyword filter and content class ---------------------------------------------------------

def _once(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def is_excluded(name: Column, terms: Sequence[str] = KIND_EXCLUDED) -> Column:
    return any_in(F.lower(name), terms)


def is_wanted(name: Column, kind: str = KIND, excluded: Sequence[str] = KIND_EXCLUDED) -> Column:
    """The name says the wanted kind and none of the excluded ones."""
    return F.lower(name).contains(kind) & ~is_excluded(name, excluded)


def content_class(documents: DataFrame, text: str = "text", terms: ContentTerms = ContentTerms()) -> DataFrame:
    """Evidence flags and VALID, REVIEW or REJECT; a null text is an ERROR."""
    def judge(flat: Column) -> Column:
        lifts = [any_in(flat, t) for t in (terms.squat, terms.bench, terms.deadlift)]
        total, place = has(flat, terms.total), has(flat, terms.place)
        subject = any_in(flat, terms.subject) | has(flat, terms.section)
        whole = lifts[0] & lifts[1] & lifts[2] & total & place
        return F.struct(
            subject.alias("has_men"), lifts[0].alias("has_squat"), lifts[1].alias("has_bench"),
            lifts[2].alias("has_deadlift"), total.alias("has_total"), place.alias("has_place"),
            whole.alias("complete_sbd"), any_in(flat, terms.excluded).alias("has_excluded_category"))

    found = documents.select("*", F.explode(F.array(_once(F.lower(squash(F.col(text))), judge))).alias("_e"))
    e = F.col("_e")
    status = (F.when(F.col(text).isNull(), "ERROR")
              .when(e["has_men"] & e["complete_sbd"] & ~e["has_excluded_category"], "VALID")
              .when(e["has_squat"] | e["has_bench"] | e["has_deadlift"], "REVIEW").otherwise("REJECT"))
    return found.select(*documents.columns, status.alias("content_status"), "_e.*")


def keep_status(sources: DataFrame, wanted: Sequence[str], status: str = "content_status") -> DataFrame:
    return sources.where(F.col(status).isin(*wanted))


def status_counts(sources: DataFrame, status: str = "content_status") -> DataFrame:
    return sources.groupBy(status).agg(F.count(F.lit(1)).alias("sources"))


def review_sample(rows: DataFrame, n: int, status: str = "status") -> DataFrame:
    """The first n rows under review in the order of their columns, for eyes only."""
    return rows.where(F.col(status) == "REVIEW").orderBy(*rows.columns).limit(n)


# ---- format profile ---------------------------------------------------------------------------

def masked_line(line: Column) -> Column:
    """Lower case, numbers as #, single blanks: headers that differ in digits become equal."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(line)), r"\d+(?:\.\d+)?", "#"),
                            SPACES, " ")


def format_profile(documents: DataFrame, text: str = "text", terms: FormatTerms = FormatTerms()) -> DataFrame:
    """Vocabulary flags, header lines, size and format signature per document.

    Digits are masked before header words are looked up, so words with digits never count.
    """
    lower = F.lower(F.col(text))
    flags = {n: has(lower, p) for n, p in terms.features.items()}

    def is_header(line: Column) -> Column:
        return _once(masked_line(line), lambda m: sum(
            m.contains(w).cast("int") for w in terms.header_words) >= terms.header_score)

    lines = raw_lines(F.col(text))
    facts = _once(lines, lambda ls: F.struct(
        F.size(ls).alias("lines"), F.transform(F.filter(ls, is_header), strip).alias("headers")))
    found = documents.select("*", *[c.alias(n) for n, c in flags.items()], F.explode(F.array(facts)).alias("_f"))
    named = F.array_join(F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in flags]), lambda x: x.isNotNull()), "|")
    first = F.coalesce(masked_line(F.get("_f.headers", F.lit(0))), F.lit(""))
    return found.select(
        *documents.columns, *flags, F.slice("_f.headers", 1, 5).alias("header_examples"),
        F.size("_f.headers").alias("header_lines"), F.col("_f.lines").alias("lines"),
        F.length(F.col(text)).alias("characters"),
        F.substring(F.sha2(F.concat(named, F.lit("||"), first), 256), 1, 12).alias("format_signature"))


def format_groups(profiles: DataFrame, name: str) -> DataFrame:
    """Documents per signature with the first and last name; the members stay rows of the profile.

    One signature may cover a third of all documents, so its members are never put into one list.
    """
    return profiles.groupBy("format_signature").agg(
        F.count(F.lit(1)).alias("file_count"), F.min(name).alias("first_file"), F.max(name).alias("last_file"))


def extraction_facts(documents: DataFrame, text: str = "text", page_break: str = r"\f") -> DataFrame:
    """Pages, characters and outcome of a text extraction."""
    known = F.col(text).isNotNull()
    return documents.select(
        *[c for c in documents.columns if c != text],
        F.when(known, "SUCCESS").otherwise("FAILED").alias("extraction_status"),
        F.when(known, F.size(F.split(F.col(text), page_break))).alias("pages"),
        F.length(F.col(text)).alias("characters"))


def file_facts(files: DataFrame, content: str = "content") -> DataFrame:
    """Size, sha256 and magic-byte check of raw files."""
    c = F.col(content)
    magic = F.substring(c, 1, 4) == F.lit(b"%PDF")
    return files.select(
        *[n for n in files.columns if n not in (content, "length", "modificationTime")],
        F.length(c).alias("size_bytes"), F.sha2(c, 256).alias("sha256"),
        F.when(F.coalesce(magic, F.lit(False)), "VALID").otherwise("INVALID").alias("file_status"))
