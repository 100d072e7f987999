"""The catalogue of named queries with the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalogue:
    """Named plans; ``sql`` holds what DuckDB runs over the same tables, where SQL can say it."""

    plans: dict[str, Plan] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def add(plan: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"{name} is taken")
            self.plans[name] = plan
            if sql is not None:
                self.sql[name] = sql
            return plan

        return add


CORE = Catalogue()
