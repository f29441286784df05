"""Meet-day planning: gap analysis, objective targets, attempt plans and their reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.functions.arrays import known, let
from meetlake.functions.numbers import STEP, plate_ceil, plate_floor, plate_round
from meetlake.schema import LIFTS

# fixed values: opener, second attempt and third-attempt ceiling as shares of the current best
STRATEGIES = {"Conservative": (0.93, 1.00, 1.04), "Balanced": (0.95, 1.02, 1.07), "Aggressive": (0.97, 1.04, 1.10)}


def gap_analysis(athletes: DataFrame, bronze: str = "bronze") -> DataFrame:
    """Gap to bronze, shared over the lifts by their present contribution.

    Negative lifts or benchmarks fail the job; lifts are never planned below their present value.
    """
    lifts = {k: F.col(f"best_{k}") for k in LIFTS}
    bad = F.lit(False)
    for c in (*lifts.values(), F.col(bronze)):
        bad = bad | (c < 0)
    checked = athletes.withColumn("_total", F.when(bad, F.raise_error(F.lit(
        "lifts and benchmark cannot be negative")).cast("double")).otherwise(sum(lifts.values())))
    total, mark = F.col("_total"), F.col(bronze)
    gap = F.greatest(F.lit(0.0), mark - total)
    share = {k: F.when(total > 0, c / total).otherwise(F.lit(1 / 3)) for k, c in lifts.items()}
    per_lift = {k: F.greatest(F.lit(0.0), (c + gap * share[k]) - c) for k, c in lifts.items()}
    top = F.greatest(*per_lift.values())
    priority = F.when(gap <= 0, F.lit("none"))
    for k in LIFTS:
        priority = priority.when(per_lift[k] == top, F.lit(k))
    return checked.select(
        *athletes.columns, F.bround(total, 2).alias("current_total"),
        F.bround(F.greatest(mark, total), 2).alias("target_total"), F.bround(gap, 2).alias("total_gap"),
        *[share[k].alias(f"share_{k}") for k in LIFTS],
        *[F.bround(lifts[k] + gap * share[k], 2).alias(f"target_{k}") for k in LIFTS],
        *[F.bround(per_lift[k], 2).alias(f"gap_{k}") for k in LIFTS],
        *[F.bround(F.lit(1 / 3) - share[k], 4).alias(f"weakness_{k}") for k in LIFTS],
        priority.alias("priority_lift"))


def objective_target(objective: Column, total: Column, podium: Column, fifth: Column) -> Column:
    """Planning target of an objective, at least one plate step above the present total."""
    step = total + STEP
    podium_known = F.coalesce(podium, F.lit(0.0)) > 0
    goal = (F.when((objective == "Podium") & podium_known, F.greatest(step, podium))
            .when((objective == "Top 5") & fifth.isNotNull(), F.greatest(step, fifth)).otherwise(step))
    return plate_ceil(goal)


def _by_strategy(strategy: Column, position: int) -> Column:
    out = F.lit(STRATEGIES["Balanced"][position])
    for name, shares in STRATEGIES.items():
        if name != "Balanced":
            out = F.when(strategy == name, F.lit(shares[position])).otherwise(out)
    return out


def attempt_plan(athletes: DataFrame, target: str = "target_total", strategy: str = "strategy") -> DataFrame:
    """Three attempts per lift toward a target total; a missing lift counts as zero.

    Thirds start at a proportional share of the wanted increase under each lift's ceiling; then single
    plate steps go to the lift with the largest open share until the target or all ceilings are reached.
    The number of steps is bounded by the distance to the ceilings.
    """
    now = {k: F.greatest(F.lit(0.0), F.col(f"best_{k}")) for k in LIFTS}
    s = F.col(strategy)
    base = athletes.withColumns({f"{k}_now": c for k, c in now.items()})
    base = base.withColumns({f"{k}_open": F.least(plate_round(F.col(f"{k}_now") * _by_strategy(s, 0)),
                                                  plate_round(F.col(f"{k}_now"))) for k in LIFTS})
    base = base.withColumns({f"{k}_second": F.greatest(F.col(f"{k}_open"), plate_round(
        F.col(f"{k}_now") * _by_strategy(s, 1))) for k in LIFTS})
    base = base.withColumns({f"{k}_cap": F.greatest(F.col(f"{k}_second"), plate_floor(
        F.col(f"{k}_now") * _by_strategy(s, 2))) for k in LIFTS})
    total = sum(F.col(f"{k}_now") for k in LIFTS)
    base = base.withColumns({"_total": total, "target_rounded": plate_ceil(F.greatest(F.col(target), total))})
    base = base.withColumn("_rise", F.greatest(F.lit(0.0), F.col("target_rounded") - F.col("_total")))
    base = base.withColumns({f"{k}_share": F.when(F.col("_total") != 0, F.col(f"{k}_now") / F.col("_total")).otherwise(
        F.lit(1 / 3)) for k in LIFTS})
    wish = {k: F.col(f"{k}_now") + F.col("_rise") * F.col(f"{k}_share") for k in LIFTS}
    base = base.withColumns({f"{k}_wish": w for k, w in wish.items()})
    start = {k: F.least(F.col(f"{k}_cap"), F.greatest(F.col(f"{k}_second"), plate_round(F.col(f"{k}_wish")))) for k in LIFTS}
    base = base.withColumns({f"{k}_start": c for k, c in start.items()})

    # candidates as (open share, present value, minus position): the largest one takes the step
    open_lifts = ", ".join(
        f"CASE WHEN s.{k} + {STEP}D <= {k}_cap + 1e-9D THEN named_struct('open', {k}_wish - s.{k}, 'now', {k}_now, 'at', {-i}) END"
        for i, k in enumerate(LIFTS))
    raised = ", ".join(f"'{k}', s.{k} + IF(p.at = {-i}, {STEP}D, 0D)" for i, k in enumerate(LIFTS))
    step = let(f"array_max({known(f'array({open_lifts})')})",
               lambda p: f"CASE WHEN {p} IS NULL THEN s ELSE named_struct({raised.replace('p.at', p + '.at')}) END")
    slack = " + ".join(f"{k}_cap - {k}_start" for k in LIFTS)
    start = ", ".join(f"'{k}', {k}_start" for k in LIFTS)
    walk = (f"aggregate(sequence(0, CAST(ceil(({slack}) / {STEP}D) AS int)), named_struct({start}), (s, n) -> "
            f"CASE WHEN target_rounded - (s.squat + s.bench + s.deadlift) >= {STEP}D THEN {step} ELSE s END)")
    done = base.select("*", F.expr(f"explode(array({walk}))").alias("_third"))

    def reason(k: str) -> Column:
        third = F.col(f"_third.{k}")
        reach = F.col("target_rounded") * F.col(f"{k}_share") + F.col(f"{k}_now")
        return (F.when(third <= F.col(f"{k}_second"), "Protect the total")
                .when(third >= F.col(f"{k}_cap") - 1e-9, "Realistic upside ceiling")
                .when(third >= reach - 1e-9, "Pursue the target").otherwise("Realistic upside"))

    return done.select(
        *athletes.columns, "target_rounded",
        *[c for k in LIFTS for c in (
            F.col(f"{k}_now").alias(f"{k}_current"), F.col(f"{k}_open").alias(f"{k}_attempt_1"),
            F.col(f"{k}_second").alias(f"{k}_attempt_2"), F.col(f"_third.{k}").alias(f"{k}_attempt_3"),
            F.col(f"{k}_cap"), reason(k).alias(f"{k}_reason_3"))])


def plan_status(plans: DataFrame, target: str = "target_total") -> DataFrame:
    """Planned total from the third attempts, its distance to the target, and a verdict."""
    planned = sum(F.coalesce(F.col(f"{k}_attempt_3"), F.lit(0.0)) for k in LIFTS)
    apart = planned - F.col(target)
    return plans.withColumns({
        "planned_total": planned, "difference": apart,
        "plan_status": F.when(F.abs(apart) < 0.01, "Target aligned").when(apart > 0, "Above target").otherwise(
            "Realistic plan below target")})


def focus_lift(plans: DataFrame) -> DataFrame:
    """Lift with the largest and the smallest planned gain; the first lift wins a tie."""
    gains = [F.struct((F.col(f"{k}_attempt_3") - F.col(f"{k}_current")).alias("gain"), F.lit(-i).alias("at"),
                      F.lit(k).alias("lift")) for i, k in enumerate(LIFTS)]
    falls = [F.struct((F.col(f"{k}_attempt_3") - F.col(f"{k}_current")).alias("gain"), F.lit(i).alias("at"),
                      F.lit(k).alias("lift")) for i, k in enumerate(LIFTS)]
    return plans.withColumns({"focus_lift": F.array_max(F.array(*gains))["lift"],
                              "stable_lift": F.array_min(F.array(*falls))["lift"]})


def gap_label(gap: Column) -> Column:
    return F.when(gap <= 0, "Target reached").otherwise(F.format_string("+%.1f kg needed", gap))


def gap_band(total: Column, gap: Column) -> Column:
    """How far the target is: no baseline, reached, close, meaningful or substantial."""
    return (F.when(total <= 0, "no baseline").when(gap <= 0, "reached").when(gap <= 25, "close")
            .when(gap <= 60, "meaningful").otherwise("substantial"))
