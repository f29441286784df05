"""Queries over the document and page tables.

The tables hold invented prose, so the vocabularies are replaced by words that occur in it.
"""

from pyspark.sql import functions as F

from meetlake.operators import documents as DC
from meetlake.operators import pages as PG
from meetlake.plans.registry import query
from meetlake.plans.tables import texts

BASE = "https://archive.example"
TERMS = DC.ContentTerms(subject=(" the ", " de "), section=r"\b(an|re)\s*-\s*\d+", squat=("tion", " la "),
                        bench=("ing ", "ment "), deadlift=("thed", "eaux"), total=r"\bof\b|\bla\b",
                        place=r"\bin\b|\ble\b", excluded=("shsh", "oioi"))
FLAT = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


def _has(*words):
    return "(" + " OR ".join(f"contains(flat, '{w}')" for w in words) + ")"



def _word(text, pattern):
    """A whole-word test whose borders follow Unicode letters, as RE2 knows only ASCII borders."""
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_])({pattern})($|[^\\p{{L}}\\p{{N}}_])')"


CONTENT_SQL = f"""
flat AS (SELECT doc_id, {FLAT} AS flat FROM documents),
flags AS (
  SELECT doc_id, {_has(*TERMS.subject)} OR regexp_matches(flat, '(^|[^\\p{{L}}\\p{{N}}_])(an|re)\\s*-\\s*\\d+') AS has_men,
    {_has(*TERMS.squat)} AS has_squat, {_has(*TERMS.bench)} AS has_bench, {_has(*TERMS.deadlift)} AS has_deadlift,
    {_word('flat', 'of|la')} AS has_total, {_word('flat', 'in|le')} AS has_place,
    {_has(*TERMS.excluded)} AS has_excluded_category FROM flat),
judged AS (
  SELECT *, has_squat AND has_bench AND has_deadlift AND has_total AND has_place AS complete_sbd,
    CASE WHEN has_men AND complete_sbd AND NOT has_excluded_category THEN 'VALID'
      WHEN has_squat OR has_bench OR has_deadlift THEN 'REVIEW' ELSE 'REJECT' END AS content_status FROM flags)"""


@query("content_class", f"WITH {CONTENT_SQL} SELECT * FROM judged")
def content_class(spark, d):
    return DC.content_class(texts(spark, d, "documents").select("doc_id", "text"), terms=TERMS).drop("text")


@query("content_status_counts", f"WITH {CONTENT_SQL} SELECT content_status, count(*) AS sources FROM judged "
       "WHERE content_status IN ('VALID', 'REVIEW') GROUP BY 1")
def content_status_counts(spark, d):
    judged = DC.content_class(texts(spark, d, "documents").select("doc_id", "text"), terms=TERMS)
    return DC.status_counts(DC.keep_status(judged, ("VALID", "REVIEW")))


@query("keyword_filter", """
SELECT doc_id, contains(lower(text), 'tion') AND NOT (contains(lower(text), 'shsh') OR contains(lower(text), 'oioi')
  OR contains(lower(text), 'bench press')) AS wanted FROM documents""")
def keyword_filter(spark, d):
    return PG.keyword_flags(texts(spark, d, "documents"), "text", "tion", ("shsh", "oioi", "bench press")).select(
        "doc_id", "wanted")


FORMATS = DC.FormatTerms(
    features={"has_the": r"\bthe\b", "has_de": r"\bde\b", "has_and": r"\b(and|und)\b", "has_digit": r"\d"},
    header_words=("tion", "re", "an", "en", "or", "le"), header_score=4)
_BREAKS = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]'"
PROFILE_SQL = f"""
lines AS (
  SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(
    regexp_replace(text, '(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e])\\z', ''), {_BREAKS}) END AS ls FROM documents),
masked AS (
  SELECT *, list_transform(ls, lambda l: regexp_replace(regexp_replace(
    lower(regexp_replace(l, '^\\s+|\\s+$', '', 'g')), '\\d+(?:\\.\\d+)?', '#', 'g'), '\\s+', ' ', 'g')) AS ms FROM lines),
headed AS (
  SELECT *, list_filter(ms, lambda m: {" + ".join(f"contains(m, '{w}')::INT" for w in FORMATS.header_words)} >= 4) AS hs
  FROM masked),
profiles AS (
  SELECT doc_id, {_word('lower(text)', 'the')} AS has_the, {_word('lower(text)', 'de')} AS has_de,
    {_word('lower(text)', 'and|und')} AS has_and, regexp_matches(lower(text), '\\d') AS has_digit,
    CAST(len(hs) AS INTEGER) AS header_lines, CAST(len(ls) AS INTEGER) AS lines, CAST(length(text) AS INTEGER) AS characters,
    substr(sha256(array_to_string(list_filter([CASE WHEN has_the THEN 'has_the' END, CASE WHEN has_de THEN 'has_de' END,
      CASE WHEN has_and THEN 'has_and' END, CASE WHEN has_digit THEN 'has_digit' END], lambda x: x IS NOT NULL), '|')
      || '||' || coalesce(hs[1], '')), 1, 12) AS format_signature FROM headed)"""


def profiles(spark, d):
    return DC.format_profile(texts(spark, d, "documents").select("doc_id", "text"), terms=FORMATS).drop(
        "text", "header_examples")


@query("format_profile", f"WITH {PROFILE_SQL} SELECT * FROM profiles")
def format_profile(spark, d):
    return profiles(spark, d)


@query("format_headers", f"""WITH {PROFILE_SQL}
SELECT doc_id, array_to_string(list_transform(list_filter(ls, lambda l, i: list_contains(hs, ms[i]))[1:5],
  lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), '|') AS header_examples FROM headed""")
def format_headers(spark, d):
    """The first five header lines of every document, which format_profile leaves out, as one text."""
    found = DC.format_profile(texts(spark, d, "documents").select("doc_id", "text"), terms=FORMATS)
    return found.select("doc_id", F.array_join("header_examples", "|").alias("header_examples"))


@query("format_signature", f"""WITH {PROFILE_SQL}
SELECT format_signature, count(*) AS file_count, min(doc_id) AS first_file, max(doc_id) AS last_file
FROM profiles GROUP BY 1""")
def format_signature(spark, d):
    return DC.format_groups(profiles(spark, d), "doc_id")


@query("extraction_facts", """
SELECT doc_id, 'SUCCESS' AS extraction_status, CAST(len(string_split(text, chr(10))) AS INTEGER) AS pages,
  CAST(length(text) AS INTEGER) AS characters FROM documents""")
def extraction_facts(spark, d):
    return DC.extraction_facts(texts(spark, d, "documents").select("doc_id", "text"), page_break="\n")


@query("file_facts", """
SELECT page_id, CAST(octet_length(encode(html)) AS INTEGER) AS size_bytes, sha256(html) AS sha256,
  CASE WHEN html LIKE '%PDF%' AND left(html, 4) = '%PDF' THEN 'VALID' ELSE 'INVALID' END AS file_status FROM pages""")
def file_facts(spark, d):
    raw = texts(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return DC.file_facts(raw)


_LINKS_SQL = """
anchors AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>[^<]*</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1)) AS label,
    generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>[^<]*</a>', 1), 1) AS position FROM pages),
links AS (
  SELECT page_id, trim(label) AS label, CASE WHEN href LIKE 'http%' THEN href WHEN left(href, 1) = '/'
      THEN 'https://archive.example' || href ELSE 'https://archive.example/' || href END AS url, position FROM anchors)"""


@query("year_links", f"""WITH {_LINKS_SQL}
SELECT page_id, url, arg_max(label, position) AS label FROM links
WHERE regexp_full_match(label, '[a-z]{{4}}') GROUP BY page_id, url""")
def year_links(spark, d):
    return PG.labelled_links(texts(spark, d, "pages"), BASE, r"^[a-z]{4}$")


@query("men_links")
def men_links(spark, d):
    return PG.competition_blocks(texts(spark, d, "pages"), BASE, "the", "the", "the", ("shsh",))


@query("source_rows")
def source_rows(spark, d):
    """Pages stand for year pages by the path of their url, so that links of some pages lead to others."""
    pages = texts(spark, d, "pages")
    years = pages.select("page_id", F.concat(F.lit(BASE), F.regexp_extract("url", r"(/[a-z]+)/", 1)).alias("url"), "html")
    blocks = PG.competition_blocks(pages, BASE, "the", "the", "the", ("shsh",))
    return PG.source_rows(PG.labelled_links(pages, BASE, r"^[a-z]{4}$"), years, blocks)
