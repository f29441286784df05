"""Podium thresholds, competitor fields, rankings and class comparison, answered in batch.

A question names a class, a target year and optionally division, equipment, tier and meet. Questions
never meet raw results: results are first reduced to one row per (class, year, division, equipment,
meet), whose number does not depend on how many results were filed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions.text import canonical_division, canonical_equipment, checked_tier, class_index, strip
from meetlake.operators.ordered import running_before

FIELD = ("weight_class", "year", "division", "equipment", "competition")
# fixed values: scope labels from the closest to the widest, and words that mark a tier in a meet name
SCOPES = ("exact division + equipment", "same division, any equipment", "same equipment, any division",
          "same weight class, any division/equipment")
TIER_WORDS = {"national": "national", "international": "international|world|asia|asian"}
SPARE = 6  # a podium takes at most three values and skips at most three


def _highest(distinct: DataFrame, keys: Sequence[str], n: int = SPARE) -> DataFrame:
    """Highest n of distinct totals per key; the rank limit also runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("total").desc()))
    return distinct.where("total IS NOT NULL").withColumn("_rank", rank).where(F.col("_rank") <= n).select(*keys, "total")


def top_totals(rows: DataFrame, keys: Sequence[str] = FIELD, n: int = SPARE) -> DataFrame:
    """Highest n distinct totals per key."""
    return _highest(rows.select(*keys, "total").distinct(), keys, n)


def field_table(results: DataFrame) -> DataFrame:
    """Per field key: records, best total of each of the first three places, highest distinct totals.

    All podium questions read this table; its size follows the number of fields, not of results. Both
    parts come from one grouping by field and total.
    """
    per_total = results.groupBy(*FIELD, "total").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("place") == k).alias(f"n_{k}") for k in (1, 2, 3)])
    sums = per_total.groupBy(*FIELD).agg(
        F.sum("n").alias("records"),
        *[F.max(F.when(F.col(f"n_{k}") > 0, F.col("total"))).alias(f"place_{k}") for k in (1, 2, 3)])
    highest = _highest(per_total, FIELD).groupBy(*FIELD).agg(F.collect_list("total").alias("totals"))
    return sums.join(highest, list(FIELD), "left")


def prepared_questions(questions: DataFrame) -> DataFrame:
    """Trimmed questions with normalised division and equipment; missing optional columns are null.

    An unknown meet tier fails the job.
    """
    have = set(questions.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return questions.select(
        F.col("question_id"), F.col("weight_class").alias("q_class"), F.col("target_year").cast("int").alias("target_year"),
        canonical_division(text("division")).alias("q_division"),
        canonical_equipment(text("equipment")).alias("q_equipment"),
        F.lower(F.when(strip(text("meet_tier")) != "", checked_tier(text("meet_tier")))).alias("q_tier"), strip(text("competition")).alias("q_meet"))


def _scope(with_meet: bool) -> Column:
    """Two steps per scope, first with the asked meet, then without it; lower is closer."""
    division = F.coalesce(F.col("division") == F.col("q_division"), F.col("q_division").isNull())
    equipment = F.coalesce(F.upper("equipment") == F.col("q_equipment"), F.col("q_equipment").isNull())
    level = (F.when(division & equipment, 0).when(F.col("q_division").isNotNull() & division, 1)
             .when(F.col("q_equipment").isNotNull() & equipment, 2).otherwise(3))
    if not with_meet:
        return level * 2
    return level * 2 + F.when(F.trim("competition") == F.col("q_meet"), 0).otherwise(1)


def _hint() -> Column:
    """0 for the asked meet itself, 1 for a meet of the asked tier, 2 for any other."""
    meet = F.lower("competition")
    tier = F.coalesce(*[F.when(F.col("q_tier") == t, meet.rlike(w)) for t, w in TIER_WORDS.items()], F.lit(False))
    return F.when(F.trim("competition") == F.col("q_meet"), 0).when(tier, 1).otherwise(2)


def history_years(asked: DataFrame, field: DataFrame, n: int = 3) -> DataFrame:
    """Questions with the newest n years before their target that have rows in the closest scope.

    A question meets one row per scope and year, so its window holds a few dozen rows.
    """
    slim = field.groupBy("weight_class", "year", "division", "equipment").agg(F.count(F.lit(1)).alias("n"))
    near = asked.join(slim, (F.col("q_class") == F.col("weight_class")) & (F.col("year") < F.col("target_year")))
    per_scope = near.select(*asked.columns, "year", (_scope(False) / 2).cast("int").alias("scope")).distinct()
    whole = Window.partitionBy("question_id")
    closest = per_scope.withColumn("_best", F.min("scope").over(whole)).where("scope = _best")
    newest = F.row_number().over(whole.orderBy(F.col("year").desc()))
    return closest.withColumn("_rank", newest).where(F.col("_rank") <= n).select(
        *asked.columns, F.col("year").alias("asked_year"), "scope")


def _chosen_fields(asked_years: DataFrame, field: DataFrame, with_hint: bool) -> DataFrame:
    """Field keys each question uses in each asked year: the closest scope, then the closest hint.

    The window holds the field keys of one class and year, not their results.
    """
    near = asked_years.join(field, (F.col("q_class") == F.col("weight_class")) & (F.col("asked_year") == F.col("year")))
    level = F.struct(_scope(True).alias("scope"), (_hint() if with_hint else F.lit(0)).alias("hint"))
    whole = Window.partitionBy("question_id", "asked_year")
    return near.withColumn("level", level).withColumn("_best", F.min("level").over(whole)).where(
        "level = _best").drop("_best")


def year_podiums(asked_years: DataFrame, field: DataFrame) -> DataFrame:
    """Gold, silver and bronze totals per question and asked year; incomplete podiums drop out.

    Official places come first; open slots are filled by the highest totals not yet on the podium.
    """
    chosen = _chosen_fields(asked_years, field, with_hint=True)
    places = chosen.groupBy("question_id", "target_year", "asked_year").agg(*[F.max(f"place_{k}").alias(f"p{k}") for k in (1, 2, 3)])
    keyed = chosen.select("question_id", "asked_year", F.explode("totals").alias("total"))
    spare = top_totals(keyed, ("question_id", "asked_year")).groupBy("question_id", "asked_year").agg(
        F.sort_array(F.collect_list("total"), asc=False).alias("totals"))
    both = places.join(spare, ["question_id", "asked_year"])
    left = F.array_except("totals", F.array("p1", "p2", "p3"))
    open_1, open_2 = (F.col(p).isNull().cast("int") for p in ("p1", "p2"))
    return both.withColumn("left", left).select(
        "question_id", "target_year", F.col("asked_year").alias("year"),
        F.coalesce("p1", F.get("left", F.lit(0))).alias("gold"),
        F.coalesce("p2", F.get("left", open_1)).alias("silver"),
        F.coalesce("p3", F.get("left", open_1 + open_2)).alias("bronze")).where(
        "gold IS NOT NULL AND silver IS NOT NULL AND bronze IS NOT NULL")


def podium_history(questions: DataFrame, field: DataFrame) -> DataFrame:
    """Complete podiums of the target year and of the three history years of each question."""
    asked = prepared_questions(questions)
    years = asked.withColumn("asked_year", F.col("target_year")).unionByName(history_years(asked, field).drop("scope"))
    return year_podiums(years, field)


def podium_threshold(questions: DataFrame, field: DataFrame) -> DataFrame:
    """Podium totals for the target year of each question.

    The real podium when the year has one; the only earlier podium when there is just one; else a linear
    trend over up to three earlier podiums, floored at zero and kept in medal order. Questions without
    any podium get no row.
    """
    shown = podium_history(questions, field)
    metals = ("gold", "silver", "bronze")
    actual, past = F.col("year") == F.col("target_year"), F.col("year") < F.col("target_year")

    def over(test: Column, agg, *cols: str) -> Column:
        return agg(*[F.when(test, F.col(c)) for c in cols])

    facts = [over(past, F.count, "year").alias("n"), over(past, F.max, "year").alias("last_year"),
             over(past, F.max_by, "bronze", "year").alias("newest"), over(past, F.min_by, "bronze", "year").alias("oldest")]
    for m in metals:
        facts += [over(actual, F.max, m).alias(f"real_{m}"), over(past, F.max_by, m, "year").alias(f"last_{m}"),
                  over(past, F.regr_slope, m, "year").alias(f"slope_{m}"),
                  over(past, F.regr_intercept, m, "year").alias(f"base_{m}")]
    per = shown.groupBy("question_id", "target_year").agg(*facts)
    is_real, single = F.col("real_gold").isNotNull(), F.col("n") == 1
    trend = {m: F.greatest(F.lit(0.0), F.col(f"base_{m}") + F.col(f"slope_{m}") * F.col("target_year")) for m in metals}
    gold = F.greatest(*trend.values())
    silver = F.least(gold, F.greatest(trend["silver"], trend["bronze"]))
    ordered = {"gold": gold, "silver": silver, "bronze": F.least(silver, trend["bronze"])}

    def pick(real, one, many) -> Column:
        return F.when(is_real, real).when(single, one).otherwise(many)

    return per.select(
        "question_id", "target_year",
        *[F.bround(pick(F.col(f"real_{m}"), F.col(f"last_{m}"), ordered[m]), 2).alias(m) for m in metals],
        pick(F.lit("flat"), F.lit("flat"),
             F.when(F.col("newest") > F.col("oldest"), "rising").when(F.col("newest") < F.col("oldest"), "falling")
             .otherwise("flat")).alias("trend"),
        pick(F.lit("historical_real"), F.lit("historical_real_benchmark"),
             F.lit("future_real_data_projection")).alias("data_status"),
        F.when(is_real, F.col("target_year")).otherwise(F.col("last_year")).alias("benchmark_year"))


def podium_trend(podiums: DataFrame, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """Change of each podium value against the year before; null marks the baseline year."""
    line = Window.partitionBy(*by).orderBy("year")
    return podiums.select(*by, "year", *[c for m in ("gold", "silver", "bronze") for c in (
        F.col(m), (F.col(m) - F.lag(m).over(line)).alias(f"{m}_delta"))])


# ---- competitor fields ------------------------------------------------------------------------

def _field_choice(questions: DataFrame, field: DataFrame) -> DataFrame:
    """Field keys of each question: its target year, else the newest earlier year in scope."""
    asked = prepared_questions(questions)
    now = _chosen_fields(asked.withColumn("asked_year", F.col("target_year")), field, with_hint=False)
    now = now.select("question_id", *FIELD, (F.col("level.scope") / 2).cast("int").alias("scope"), F.lit(True).alias("current"))
    missing = asked.join(now.select("question_id").distinct(), "question_id", "left_anti")
    newest = history_years(missing, field, 1)
    earlier = newest.join(field, (F.col("q_class") == F.col("weight_class")) & (F.col("year") == F.col("asked_year")))
    earlier = earlier.where((_scope(False) / 2).cast("int") == F.col("scope")).select(
        "question_id", *FIELD, "scope", F.lit(False).alias("current"))
    return now.unionByName(earlier)


def competitors(questions: DataFrame, results: DataFrame, field: DataFrame) -> DataFrame:
    """Every result of the field each question falls back to, with scope and status labels."""
    chosen = _field_choice(questions, field)
    exact = F.col("scope") == 0
    status = (F.when(exact & F.col("current"), "historical_real").when(exact, "historical_real_benchmark")
              .otherwise("historical_real_broader_benchmark"))
    return results.join(chosen, list(FIELD)).withColumns({
        "data_status": status, "benchmark_year": F.col("year"),
        "scope_status": F.element_at(F.array(*[F.lit(s) for s in SCOPES]), F.col("scope") + 1)})


def engine_columns(field: DataFrame) -> DataFrame:
    """The planner's column names over a competitor field."""
    return field.withColumns({
        "name": F.col("athlete_name"), "placing": F.col("place").try_cast("double"),
        "total_kg": F.col("total").try_cast("double"), "wilks_or_gl": F.lit(None).cast("double"),
        "equipment": canonical_equipment(F.col("equipment")), "division": canonical_division(F.col("division"))})


def kth_total(questions: DataFrame, results: DataFrame, field: DataFrame, k: int = 5) -> DataFrame:
    """k-th highest total of each question's field; no row when the field is smaller."""
    by_field = Window.partitionBy(*FIELD).orderBy(F.col("total").desc())
    strongest = results.where("total IS NOT NULL").select(*FIELD, "total").withColumn(
        "_rank", F.row_number().over(by_field)).where(F.col("_rank") <= k).drop("_rank")
    by_question = Window.partitionBy("question_id").orderBy(F.col("total").desc())
    joined = strongest.join(_field_choice(questions, field), list(FIELD)).select("question_id", "total")
    return joined.withColumn("_rank", F.row_number().over(by_question)).where(F.col("_rank") <= k).where(
        F.col("_rank") == k).select("question_id", F.col("total").alias("benchmark"))


def leaderboard(field: DataFrame, by: Sequence[str], value: str = "projected_total", tie: str = "seq",
                n: int = 12) -> DataFrame:
    """First n of each group with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), tie)
    return field.withColumn("projected_rank", F.row_number().over(order)).where(F.col("projected_rank") <= n)


def user_ranks(users: DataFrame, field: DataFrame, by: Sequence[str], value: str = "total") -> DataFrame:
    """Rank of each user's value in its group: one more than the number of higher values.

    Works on value counts, so a group of any size is ranked without ordering its rows in one place.
    """
    known = field.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    asked = users.where(F.col(value).isNotNull()).select(*by, value, F.lit(0).cast("bigint").alias("n")).distinct()
    counts = known.unionByName(asked).groupBy(*by, value).agg(F.sum("n").alias("n")).withColumn("_down", -F.col(value))
    above = running_before(counts, list(by), ["_down"], {"_above": ("sum", F.col("n"))})
    return users.join(above.select(*by, value, "_above"), [*by, value]).withColumn(
        "projected_rank", F.col("_above") + 1).drop("_above")


def podium_gaps(users: DataFrame, thresholds: DataFrame, on: Sequence[str] = ("question_id",),
                total: str = "total") -> DataFrame:
    """Distance of each user to every podium value, never below zero.

    Thresholds have one row per question, that is per weight class and target year: a small table however many users ask
    the same few questions, so it is sent to the users instead of shuffling them by question.
    """
    return users.join(F.broadcast(thresholds.select(*on, "gold", "silver", "bronze")), list(on)).withColumns({
        f"{m}_gap": F.greatest(F.lit(0.0), F.col(m) - F.col(total)) for m in ("gold", "silver", "bronze")})


def class_comparison(athletes: DataFrame, thresholds: DataFrame, plan: Sequence[str] = ("target_year",)) -> DataFrame:
    """Bronze of the athlete's class and of its neighbours; the lowest one is named.

    ``thresholds`` holds one row per plan and class index, so at most plans times classes: each plan's classes become one
    map, the maps are sent to the athletes, and an athlete's three candidates are looked up in its row.
    """
    own = athletes.withColumn("class_index", class_index(F.col("bodyweight"))).where("class_index IS NOT NULL")
    bars = thresholds.groupBy(*plan).agg(F.map_from_entries(F.collect_list(F.struct("class_index", "bronze"))).alias("bars"))
    near = [F.col("class_index") + k for k in (-1, 0, 1)]
    known = F.array_compact(F.array(*[
        F.when(F.map_contains_key("bars", k), F.struct(F.element_at("bars", k).alias("bronze"), k.alias("candidate"))) for k in near]))
    per = own.join(F.broadcast(bars), list(plan)).select(
        *athletes.columns, "class_index", F.element_at("bars", near[1]).alias("current_bronze"),
        F.array_min(known).alias("low"), F.size(known).cast("bigint").alias("compared"))
    return per.where("current_bronze IS NOT NULL").select(
        *athletes.columns, "class_index", "compared", F.col("low.candidate").alias("recommended_index"),
        F.bround("current_bronze", 2).alias("current_bronze"), F.bround("low.bronze", 2).alias("recommended_bronze"),
        F.bround(F.col("low.bronze") - F.col("current_bronze"), 2).alias("difference"))
