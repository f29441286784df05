"""Order-dependent computations that stay balanced when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.session import pinned

def _combine(kind: str, value: Column, frame) -> Column:
    if kind == "count":
        return F.count(value).over(frame)
    if kind == "max":
        return F.max(value).over(frame)
    if kind == "sum":
        return F.coalesce(F.sum(value).over(frame), F.lit(0))
    if kind == "last":
        return F.last(value).over(frame)
    raise ValueError(f"unknown running measure {kind}")


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows dealt by ranges of (keys, order) and written, with their part and their place in it.

    A part holds a bounded share of the rows, whatever the keys: a large group lies in many parts, one after the other.
    """
    return pinned(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumns({
        "_part": F.spark_partition_id(), "_line": F.monotonically_increasing_id()}))


def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   measures: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add measures over the rows strictly before each row of its group, by a scan of parts.

    ``measures`` maps a new column to (kind, expression), kind being count, sum, max or last. ``order``
    must order the rows of a group without ties. Each part of the range partition runs its own windows. A part begins at
    most one group that an earlier part already holds, so the state carried into parts is one row a part: it is scanned
    over the parts' sums and sent to all tasks. Null keys are a group like others.
    """
    rows = in_parts(df.select("*", *[value.alias(f"_v_{name}") for name, (_, value) in measures.items()]), keys, order)

    whole = []
    for name, (kind, _) in measures.items():
        v = F.col(f"_v_{name}")
        total = {"count": F.count(v), "sum": F.sum(v), "max": F.max(v), "last": F.max_by(v, "_line")}[kind]
        whole.append(total.alias(f"_c_{name}"))
    by_part = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_part").agg(*whole).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"),
        F.row_number().over(Window.partitionBy(*keys).orderBy("_part")).alias("_at"), *[
            (F.sum(F.col(f"_c_{name}")) if kind in ("count", "sum") else F.max(F.col(f"_c_{name}")) if kind == "max"
             else F.last(F.col(f"_c_{name}"))).over(by_part).alias(f"_p_{name}")
            for name, (kind, _) in measures.items()]).where("_at > 1")

    inside = Window.partitionBy("_part", *keys).orderBy("_line")
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", F.row_number().over(inside).alias("_n"), *[
        _combine(kind, F.col(f"_v_{name}"), past).alias(f"_l_{name}") for name, (kind, _) in measures.items()])
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = local.join(F.broadcast(carried), same, "left")  # at most one row a part
    merged = {
        "count": lambda n: F.col(f"_l_{n}") + F.coalesce(F.col(f"_p_{n}"), F.lit(0)),
        "sum": lambda n: F.col(f"_l_{n}") + F.coalesce(F.col(f"_p_{n}"), F.lit(0)),
        "max": lambda n: F.greatest(F.col(f"_l_{n}"), F.col(f"_p_{n}")),
        "last": lambda n: F.when(F.col("_n") == 1, F.col(f"_p_{n}")).otherwise(F.col(f"_l_{n}")),
    }
    return both.select(*df.columns, *[merged[kind](name).alias(name) for name, (kind, _) in measures.items()])


# ---- percentiles by radix selection -----------------------------------------------------------

#: Bits of a pass.
DIGIT = 16


def _bits(value: Column) -> Column:
    """The bits of a double as a long that orders like it; the two zeros are one."""
    raw = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(raw < 0, raw.bitwiseXOR(F.lit(2**63 - 1))).otherwise(raw)


def _double(bits: Column) -> Column:
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def exact_percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Linearly interpolated percentiles per column, exact at any size: rows of (name, prob, value)."""
    known = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "name", "v")
    # wanted prefixes: as many as listed columns and probabilities, so the broadcast side is bounded by the lists
    return _percentiles(known, probs, F.broadcast)


def group_percentiles(df: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """The same per value of a group column, null being one: rows of (name, prob, value)."""
    known = df.select(F.col(group).alias("name"), F.col(value).cast("double").alias("v"))
    return _percentiles(known, probs, lambda side: side)


def _percentiles(values: DataFrame, probs: Sequence[float], side) -> DataFrame:
    """Radix selection over the ordered bits of the values, from the high digit to the low one.

    Each pass counts the values by their next digit, among those that agree with a wanted rank in all digits before, and
    picks the digit in which the rank lies. Counts are added up before any shuffle, so a large group is a few rows a task;
    what is left for one group is at most one count a digit.
    """
    keys = pinned(values.where("v IS NOT NULL").select("name", _bits(F.col("v")).alias("b")))
    mask = (1 << DIGIT) - 1

    def digit(p: int) -> Column:
        # the highest digit holds the sign, so it is shifted to start at 0
        d = F.shiftright("b", 64 - DIGIT * (p + 1))
        return (d + F.lit(1 << (DIGIT - 1)) if p == 0 else d.bitwiseAND(F.lit(mask))).cast("int")

    def chosen(counted: DataFrame, ranks: Column) -> DataFrame:
        """(name, prefix, wanted): for each rank, whose place among the counted is ``rest``, its digit and place inside."""
        def step(w: Column):
            def run(a: Column, x: Column) -> Column:
                here = a["digit"].isNull() & (w["rest"] < a["sum"] + x["n"])
                return F.struct((a["sum"] + x["n"]).alias("sum"), F.when(here, x["digit"]).otherwise(a["digit"]).alias("digit"),
                                F.when(here, a["sum"]).otherwise(a["before"]).alias("before"))
            return run

        zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("int").alias("digit"),
                        F.lit(0).cast("bigint").alias("before"))
        found = F.transform(ranks, lambda w: F.struct(w.alias("w"), F.aggregate("counts", zero, step(w)).alias("d")))
        return counted.select("name", "prefix", F.explode(found).alias("f")).select(
            "name", (F.shiftleft("prefix", DIGIT) + F.col("f.d.digit")).alias("prefix"), F.struct(
                F.col("f.w.prob").alias("prob"), F.col("f.w.part").alias("part"), F.col("f.w.high").alias("high"),
                (F.col("f.w.rest") - F.col("f.d.before")).alias("rest")).alias("w"))

    def listed(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.groupBy("name", "prefix").agg(F.sort_array(F.collect_list(F.struct("digit", "n"))).alias("counts"), *more)

    counts = keys.groupBy("name", digit(0).alias("digit")).agg(F.count(F.lit(1)).alias("n")).withColumn("prefix", F.lit(0).cast("bigint"))
    spot = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (spot(p) - F.floor(spot(p))).alias("part"), F.lit(high).alias("high"), (
        F.ceil(spot(p)) if high else F.floor(spot(p))).cast("bigint").alias("rest")) for p in probs for high in (False, True)])
    state = chosen(listed(counts, F.sum("n").alias("total")), ranks)
    for p in range(1, 64 // DIGIT):
        wanted = state.groupBy("name", "prefix").agg(F.collect_list("w").alias("ranks")).select(
            F.col("name").alias("_name"), F.col("prefix").alias("_prefix"), "ranks")
        high = F.shiftright("b", 64 - DIGIT * p) + F.lit(1 << (DIGIT * p - 1))
        met = keys.withColumn("prefix", high).join(
            side(wanted), F.col("name").eqNullSafe(F.col("_name")) & (F.col("prefix") == F.col("_prefix")))
        counts = met.groupBy("name", "prefix", "ranks", digit(p).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        state = chosen(listed(counts, F.first("ranks").alias("ranks")), F.col("ranks"))
    value = _double(F.col("prefix").bitwiseXOR(F.lit(-(2**63))))
    found = state.select("name", F.col("w.prob").alias("prob"), F.col("w.part").alias("part"), F.col("w.high").alias("high"), value.alias("v"))
    ends = found.groupBy("name", "prob", "part").agg(
        F.max(F.when(~F.col("high"), F.col("v"))).alias("below"), F.max(F.when(F.col("high"), F.col("v"))).alias("beyond"))
    return ends.select("name", "prob", (F.col("below") + (F.col("beyond") - F.col("below")) * F.col("part")).alias("value"))
