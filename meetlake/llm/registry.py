"""The subpackage's named queries, with SQL where SQL can state a result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def keep(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql.strip()
        return plan
    return keep
