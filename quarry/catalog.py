"""All named queries of the engine's own operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import graph_plans, payload_plans, store_plans, text_plans
from quarry.plans.shared_sql import SHARED

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return store_plans.Q | text_plans.Q | graph_plans.Q | payload_plans.Q


def oracle_sql() -> dict[str, str]:
    return SHARED | text_plans.SQL | graph_plans.SQL | payload_plans.SQL
