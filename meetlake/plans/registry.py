"""Named queries: a Spark plan next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under a name, with its oracle when SQL can state the result on whole tables."""
    def keep(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is already registered")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql.strip()
        return plan
    return keep
