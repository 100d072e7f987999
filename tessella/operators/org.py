"""Relations between repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def service_graph(edges: DataFrame) -> DataFrame:
    """``from_repo, to_repo, kind, edges`` over edges with a known target repository other than their own."""
    return edges.where("to_repo is not null and from_repo <> to_repo").groupBy("from_repo", "to_repo", "kind").agg(F.count(F.lit(1)).alias("edges"))


def producers(edges: DataFrame, published: DataFrame) -> DataFrame:
    """``edges`` with ``to_repo``: the repository that publishes the target under the same kind; a repository does not serve itself.

    Of several publishers the least name counts.
    """
    by = published.groupBy("kind", "target").agg(F.min("repo").alias("__repo"))
    return edges.drop("to_repo").join(by, ["kind", "target"], "left").withColumn("to_repo", F.when(F.col("__repo") != F.col("from_repo"), F.col("__repo"))).drop("__repo")


def migration_order(graph: DataFrame) -> DataFrame:
    """``repo, used_by, uses, stability``: ``stability = used_by / (used_by + uses)`` over the graph's edges."""
    ends = graph.select(F.col("to_repo").alias("repo"), F.col("edges").alias("i"), F.lit(0).cast("long").alias("o")).unionByName(graph.select(F.col("from_repo").alias("repo"), F.lit(0).cast("long").alias("i"), F.col("edges").alias("o")))
    return ends.groupBy("repo").agg(F.sum("i").alias("used_by"), F.sum("o").alias("uses")).withColumn("stability", F.col("used_by") / (F.col("used_by") + F.col("uses")))


def downstream(graph: DataFrame, repo: str) -> DataFrame:
    """``repo, kind, edges``: who uses a repository directly."""
    return graph.where(F.col("to_repo") == repo).select(F.col("from_repo").alias("repo"), "kind", "edges")


def private_uses(edges: DataFrame, pattern: str = r"(?i)internal|private|_lib|/_") -> DataFrame:
    """Edges into what another repository keeps to itself, told by the target path."""
    return edges.where("from_repo <> to_repo").where(F.col("target").rlike(pattern))


def replace_edges(edges: DataFrame, repo: str, new: DataFrame) -> DataFrame:
    """``edges`` in which those of ``repo`` are replaced by ``new``."""
    return edges.where(~F.col("from_repo").eqNullSafe(repo)).unionByName(new.dropDuplicates())
