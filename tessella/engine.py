"""The query facade: named queries over a data folder, families of queries, and registered rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import catalogue

#: Aliases: a family and a selector stand for a query; the first selector is the default.
FAMILIES = {
    "impact": {"blast": "blast_radius", "simulate": "simulate_change_impact", "neighbors": "neighbors", "data_flow": "forward_reach"},
    "memory": {"search": "search_decisions", "recent": "recent_decisions", "session": "session_replay", "log": "log_sessions", "interventions": "intervention_files"},
    "history": {"drift": "architectural_drift", "evolution": "domain_evolution", "hotspots": "hotspots", "events": "arch_events", "file": "file_presence", "velocity": "change_velocity", "churn": "churn", "health": "domain_health"},
    "patterns": {"invariants": "no_import_invariants", "conventions": "case_conventions", "canonical": "canonical_exemplar", "actions": "action_patterns"},
    "org": {"graph": "service_graph", "consumers": "repo_consumers", "violations": "boundary_violations", "migration": "migration_order"},
}

Rule = Callable[[dict[str, DataFrame]], DataFrame]


class Engine:
    """``Engine(spark, folder).query("churn")``; rules are functions of tables that return findings (``rule, file, line, severity``)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._rules: dict[str, Rule] = {}

    def names(self) -> list[str]:
        return sorted(catalogue.CORE.plans)

    def query(self, name: str, select: str | None = None) -> DataFrame:
        """A query by name, or of a family by its selector. Unknown names raise KeyError."""
        if name in FAMILIES:
            name = FAMILIES[name][select or next(iter(FAMILIES[name]))]
        return catalogue.CORE.plans[name](self.spark, self.folder)

    def register_rule(self, name: str, rule: Rule) -> None:
        if not callable(rule):
            raise TypeError("a rule is a function of tables")
        self._rules[name] = rule

    def findings(self, tables: dict[str, DataFrame]) -> DataFrame:
        """Findings of all rules, each once by its hash, gravest first."""
        from functools import reduce

        from pyspark.sql import functions as F

        from tessella.operators.journal import finding_hash

        parts = [rule(tables).select(F.lit(name).alias("rule"), "file", F.col("line").cast("int").alias("line"), "severity") for name, rule in self._rules.items()]
        if not parts:
            return self.spark.createDataFrame([], "rule string, file string, line int, severity string, hash string")
        rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
        return reduce(DataFrame.unionByName, parts).withColumn("hash", finding_hash("rule", "file", "line")).dropDuplicates(["hash"]).orderBy(rank, "rule", "file", "line")
