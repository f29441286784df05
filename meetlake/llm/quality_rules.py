"""Quality rules: base counts per document, and robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics. Per group (language and source) the minimum-covariance-determinant
estimate gives centre and scatter of the half of the documents that lie closest together; a document whose Mahalanobis
distance from them is too large is rejected.

The estimate is distributed: concentration steps, from several starts side by side until their determinants stop falling, alternate between one aggregation of the distances (the quantile that cuts
off the wanted share, from a mergeable sketch) and one of the moments of the documents within it. Both are added up before the
shuffle, so a group with a third of all documents is one small row a task. Groups' estimates are rows of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.shared import Rolling, discard, row_key, staged, table, text_parts, word_hashes, words_of

#: fixed values of the base rules
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"

#: The transformed statistics, and the least unit of each: statistics are measured in robust spreads of the data, pooled over
#: the groups, and one that is the same in nearly all documents (no symbols, say) in this small unit instead.
LEAST = {"log_words": 0.1, "word_length": 0.1, "symbol_share": 0.06, "dup_line_share": 0.06, "repeat_share": 0.06}
#: The part of a unit that is added to each statistic's spread in an estimate, so that no scatter is singular.
FLOORS = dict.fromkeys(LEAST, 0.3)
#: Share of the closest documents; most steps; starts side by side; the least fall of the log determinant that goes on.
SHARE, STEPS, STARTS, FALL = 0.5, 50, 4, 1e-3
#: So many documents weigh as much in a group's estimate as the estimate of its language does, and in that as the corpus's.
PRIOR = 50.0
#: The scatter of the closest half of five normal variables, times this, is that of all of them.
CONSISTENCY = 1.91
#: Largest squared distance kept: a normal vector of five exceeds it once in a million.
MAX_DISTANCE = 36.0
#: Documents have longer tails than normal vectors (short ones vary more), so distances up to so many times the lower quartile
#: of all distances are kept too. The quartile lies within the clean documents even where nearly half are not.
TAIL = 100.0

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])


def base_counts(data: np.ndarray, offsets: np.ndarray, window: int = REPEAT_WINDOW) -> list[np.ndarray]:
    """The five counts of each text of a run of texts."""
    starts, ends, bounds = words_of(data, offsets)
    n_texts = len(offsets) - 1
    # characters: bytes of words that don't continue a character
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    lead = (data & 0xC0) != 0x80
    chars = _sums((np.cumsum(inside[:-1], dtype=np.int8) > 0) & lead, offsets)
    symbols = _sums(_SYMBOL[data], offsets)
    repeats = np.zeros(n_texts, np.int64)
    if len(starts) >= window:
        grams = Rolling(word_hashes(data, starts, ends)).windows(window)
        text = np.repeat(np.arange(n_texts), np.diff(bounds))
        fits = np.flatnonzero(np.arange(len(grams)) + window <= bounds[text[:len(grams)] + 1])
        key, owner = grams[fits], text[fits]
        order = np.lexsort((key, owner))
        same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        again = np.zeros(len(order), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, fits[again], 1)
        np.add.at(change, fits[again] + window, -1)
        repeats = _sums(np.cumsum(change[:-1]) > 0, bounds)
    lines = np.zeros(n_texts, np.int64)
    raw = data.tobytes()
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        full = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]  # white space of bytes is that of the rule
        lines[k] = len(full) - len(set(full))
    return [np.diff(bounds), chars, symbols, lines, repeats]


def counted(docs: DataFrame, id_col: str, text_col: str, keys: tuple[str, ...]) -> DataFrame:
    """k1, k2, doc_id, the keys and the five counts of every row, staged."""
    schema = "k1 bigint, k2 bigint, doc_id bigint, " + ", ".join(f"{k} string" for k in keys) + ", n_lines bigint, " + (
        ", ".join(f"{c} bigint" for c in _COUNTS))
    names = ["k1", "k2", "doc_id", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_parts(batch.column("text")):
                counts = base_counts(data, offsets)
                lines = _sums(data == 10, offsets) + 1
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(low, high - low) for n in names), pa.array(lines), *map(pa.array, counts)],
                    [*names, "n_lines", *_COUNTS])

    rows = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).cast("bigint").alias("doc_id"),
                       *(F.col(k).cast("string").alias(k) for k in keys), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(run, schema), "base-counts")


def _vector() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    return [F.log1p("n_words").alias("log_words"), (F.col("word_chars") / words).alias("word_length"),
            F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_share"),
            (F.col("n_dup_lines") / F.col("n_lines")).alias("dup_line_share"),
            (F.col("n_repeat_words") / words).alias("repeat_share")]


_NAMES = tuple(FLOORS)
_P = len(_NAMES)
_ALL = "(all)"  # names of groups begin with = or are null
_ESTIMATE = "lang_group string, source_group string, start int, centre array<double>, inverse array<double>, log_det double"


def _estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of groups with centre and scatter (upper triangle) to rows with the inverse of the regularised scatter."""
    upper = np.triu_indices(_P)
    ridge = np.diag(np.square(list(FLOORS.values())))
    for frame in batches:
        inverse, log_det = [], []
        for flat in frame["scatter"]:
            scatter = np.zeros((_P, _P))
            scatter[upper] = scatter.T[upper] = flat
            inverse.append(np.linalg.inv(scatter + ridge).ravel())
            log_det.append(np.linalg.slogdet(scatter + ridge)[1])
        yield frame.drop(columns="scatter").assign(inverse=inverse, log_det=log_det)[
            ["lang_group", "source_group", "start", "centre", "inverse", "log_det"]]


def _squared_distance() -> Column:
    """Mahalanobis distance of the statistics from ``centre`` by ``inverse``; both are arrays of the row."""
    gap = [F.col(n) - F.col("centre")[i] for i, n in enumerate(_NAMES)]
    terms = [gap[i] * gap[j] * F.col("inverse")[i * _P + j] * (1 if i == j else 2) for i in range(_P) for j in range(i, _P)]
    return sum(terms[1:], terms[0])


def _starts(quartiles: DataFrame, keys: list[str], starts: int) -> DataFrame:
    """Of every group the first ``starts`` of: median and quartile range, then no scatter at the median and each quartile."""
    def start(number: int, place: int, spread: bool) -> Column:
        scatter = [F.pow((F.col(n)[2] - F.col(n)[0]) / 1.349, 2) if spread and i == j else F.lit(0.0)
                   for i, n in enumerate(_NAMES) for j in range(i, _P)]
        return F.struct(F.lit(number).alias("start"), F.array(*(F.col(n)[place] for n in _NAMES)).alias("centre"),
                        F.array(*scatter).alias("scatter"))

    chosen = [start(0, 1, True), start(1, 1, False), start(2, 0, False), start(3, 2, False)][:starts]
    return quartiles.select(*keys, F.explode(F.array(*chosen)).alias("s")).select(*keys, "s.*")


def estimates(vectors: DataFrame, share: float = SHARE, steps: int = STEPS, starts: int = 1, fall: float = 0.0) -> DataFrame:
    """MCD centre and inverse scatter of every group (lang_group, source_group), over all of its rows.

    All starts take concentration steps side by side. A step lowers the log determinant of the scatter with its ridge; a
    start ends when it falls by ``fall`` at most, and of each group's starts that with the least one is returned.
    """
    keys = ["lang_group", "source_group"]
    each = [*keys, "start"]
    quartiles = vectors.groupBy(*keys).agg(*(F.percentile_approx(n, [0.25, 0.5, 0.75], 10000).alias(n) for n in _NAMES))
    now = staged(_starts(quartiles, keys, starts).mapInPandas(_estimate, _ESTIMATE), "mcd").withColumn("log_det", F.lit(float("inf")))
    ended = []
    for _ in range(steps):
        measured = vectors.join(now, keys).withColumn("d2", _squared_distance()).select(*each, *_NAMES, "d2")
        # one row a group and start, written, so that its size decides how it meets the rows: they aren't shuffled for it
        cut = staged(measured.groupBy(*each).agg(F.percentile_approx("d2", share, 10000).alias("cut")), "mcd-cut")
        moments = measured.join(cut, each).where("d2 <= cut").groupBy(*each).agg(
            F.array(*(F.avg(n) for n in _NAMES)).alias("centre"),
            F.array(*(F.covar_pop(_NAMES[i], _NAMES[j]) * CONSISTENCY for i in range(_P) for j in range(i, _P))).alias("scatter"))
        before = now.select(*each, F.col("log_det").alias("last"))
        found = staged(moments.mapInPandas(_estimate, _ESTIMATE).join(before, each), "mcd")
        discard(cut)
        ended.append(found.where(F.col("last") - F.col("log_det") <= fall).drop("last"))
        now = found.where(F.col("last") - F.col("log_det") > fall).drop("last")
        if now.isEmpty():
            break
    for part in ended:
        now = now.unionByName(part)
    best = now.groupBy(*keys).agg(F.min(F.struct("log_det", "start", "centre", "inverse")).alias("e"))
    return staged(best.select(*keys, "e.centre", "e.inverse", "e.log_det"), "mcd")


def _shrunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates of a group, its language and the corpus (c, k, n with 2, 1, 0) to the group's, shrunk smoothly by the counts.

    Each is a mixture of its own and the wider one; that the centres differ is spread of the mixture.
    """
    for frame in batches:
        centres, inverses = [], []
        for row in frame.itertuples():
            centre, scatter = np.array(row.c0), np.linalg.inv(np.reshape(row.k0, (_P, _P)))
            for c, k, n in ((row.c1, row.k1, row.n1), (row.c2, row.k2, row.n2)):
                own, gap = n / (n + PRIOR), np.array(c) - centre
                scatter = own * np.linalg.inv(np.reshape(k, (_P, _P))) + (1 - own) * scatter + own * (1 - own) * np.outer(gap, gap)
                centre = centre + own * gap
            centres.append(centre)
            inverses.append(np.linalg.inv(scatter).ravel())
        yield frame[["lang_group", "source_group"]].assign(centre=centres, inverse=inverses)


def shrunk_estimates(vectors: DataFrame) -> DataFrame:
    """Centre and inverse of every language and source, however few documents it has."""
    names = [F.struct(lang.alias("l"), source.alias("s")) for lang, source in (
        (F.col("lang_group"), F.col("source_group")), (F.col("lang_group"), F.lit(_ALL)), (F.lit(_ALL), F.lit(_ALL)))]
    levels = vectors.select(F.explode(F.array(*names)).alias("g"), *_NAMES).select(
        F.col("g.l").alias("lang_group"), F.col("g.s").alias("source_group"), *_NAMES)
    keys = ["lang_group", "source_group"]
    fitted = estimates(levels, starts=STARTS, fall=FALL).join(levels.groupBy(*keys).count(), keys)
    fitted = staged(fitted.select(*keys, "centre", "inverse", "count"), "mcd-levels")

    def level(number: int) -> list[Column]:
        return [F.col("centre").alias(f"c{number}"), F.col("inverse").alias(f"k{number}"), F.col("count").alias(f"n{number}")]

    groups = fitted.where(F.col("source_group") != _ALL).select(*keys, *level(2))
    languages = fitted.where((F.col("lang_group") != _ALL) & (F.col("source_group") == _ALL)).select("lang_group", *level(1))
    corpus = fitted.where(F.col("lang_group") == _ALL).select(*level(0))
    joined = groups.join(languages, "lang_group").crossJoin(F.broadcast(corpus))  # one row
    return staged(joined.mapInPandas(_shrunk, "lang_group string, source_group string, centre array<double>, "
                                     "inverse array<double>"), "mcd-shrunk")


def _in_units(vectors: DataFrame, good: Column) -> DataFrame:
    """The statistics in units: 1.4826 times the median distance from the group's median over all good rows, LEAST at least."""
    keys, rows = ["lang_group", "source_group"], vectors.where(good)
    middle = rows.groupBy(*keys).agg(*(F.percentile_approx(n, 0.5, 10000).alias(f"{n}_m") for n in _NAMES))
    spread = rows.join(middle, keys).agg(*(F.percentile_approx(F.abs(F.col(n) - F.col(f"{n}_m")), 0.5, 10000).alias(n)
                                           for n in _NAMES)).first()
    return vectors.withColumns({n: F.col(n) / max(1.4826 * (spread[n] or 0.0), LEAST[n]) for n in _NAMES})


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           source_col: str = "source", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Per row: k1, k2 (its key), doc_id, the base counts, base_failed, distance (squared; null without an estimate), kept.

    Null texts have no words and fail; null languages and sources are groups of their own. Documents that fail the base
    rules take no part in the estimates. A group's estimate is shrunk towards that of its language, and this towards the
    corpus's, the more the fewer documents there are, so every document gets a verdict. Repeated rows count as often as they
    come. Other columns are not looked at.
    """
    rows = counted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang"),
                               F.col(source_col).alias("source")), "id", "body", ("lang", "source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select("*", failed.alias("base_failed"), *_vector(),
                       *(F.coalesce(F.concat(F.lit("="), c), F.lit("null")).alias(f"{c}_group") for c in ("lang", "source")))
    rows = _in_units(rows, ~F.col("base_failed"))
    fitted = shrunk_estimates(rows.where("not base_failed"))
    measured = rows.join(fitted, ["lang_group", "source_group"], "left").withColumn("distance", _squared_distance())
    quarter = measured.where("not base_failed").agg(F.percentile_approx("distance", 0.25, 10000)).first()[0]
    max_distance = max(max_distance, TAIL * (quarter or 0.0))
    return measured.select("k1", "k2", "doc_id", *_COUNTS, "base_failed", "distance",
                           (~F.col("base_failed") & F.coalesce(F.col("distance") <= max_distance, F.lit(True))).alias("kept"))


def kept_documents(docs: DataFrame, **columns: str) -> DataFrame:
    """The documents that the rules keep, unchanged; rows that repeat an id and text share one verdict."""
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    good = judged(docs, **columns).where("kept").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    one, two = (c.alias(f"__{k}") for c, k in zip(row_key(docs[id_col], docs[text_col]), ("k1", "k2")))
    return docs.select("*", one, two).join(good, ["__k1", "__k2"], "left_semi").select(
        *(F.col(f"`{c}`") for c in docs.columns))


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("k1", "k2")
