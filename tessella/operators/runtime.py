"""Calls, routes and traces: matching what is called with what is served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route_shape(path: Column) -> Column:
    """A path without its query in which parameters, numbers and UUID heads read as ``:id``."""
    parts = F.split(F.regexp_replace(path, r"\?.*$", ""), "/")
    one = lambda x: F.when(x.rlike(r"^:|^\{.*\}$|^\d+$|^[0-9a-f]{8}-[0-9a-f]{4}"), ":id").otherwise(x)
    return F.array_join(F.transform(parts, one), "/")


#: A call by its callee and the text of its arguments, which may hold calls of calls; runs are possessive, so a text without an end costs no more than its length.
_CALL = r"(?<![\w.])((?:window\.)?fetch|axios(?:\.\w+)?|(?:\$|jQuery)\.\w+)\s*\(((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)\)"
_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def calls(contents: DataFrame) -> DataFrame:
    """Distinct ``file, method, path`` of the HTTP calls in the texts (``file, content``): fetch, axios and jQuery.

    The path is the first literal of the arguments that begins with ``/``, wherever it stands (``axios({method: 'post', url: '/x'})``), without its query; what a template string
    fills in reads as ``:id``. The method is the callee's, else the one the arguments name as ``method`` or ``type``, else GET, or ALL for a bare ``ajax``.
    """
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(_CALL), 1).alias("callee"), F.regexp_extract_all("content", F.lit(_CALL), 2).alias("given"))
    rows = contents.select("file", F.explode(found).alias("c")).select("file", F.upper(F.substring_index("c.callee", ".", -1)).alias("verb"), F.regexp_replace("c.given", r"\$\{[^}]*\}", ":id").alias("given"))
    path = F.regexp_replace(F.regexp_extract("given", "[`'\"](/[^`'\"\\s]+)[`'\"]", 1), r"\?.*$", "")
    named = F.upper(F.regexp_extract("given", "\\b(?:method|type)[`'\"]?\\s*:\\s*[`'\"](\\w+)", 1))
    method = F.when(F.col("verb").isin(*_VERBS), F.col("verb")).when(named != "", named).when(F.col("verb") == "AJAX", "ALL").otherwise("GET")
    return rows.select("file", method.alias("method"), path.alias("path")).where("path <> ''").distinct()


def match_calls(called: DataFrame, routes: DataFrame) -> DataFrame:
    """``file, method, path, route_file, route_path``: each call with its routes by method and shape, else by shape alone, else with null."""
    c = called.select("file", "method", "path", route_shape(F.col("path")).alias("shape"))
    r = routes.select(F.col("method").alias("rm"), route_shape(F.col("path")).alias("shape"), F.col("file").alias("route_file"), F.col("path").alias("route_path"))
    exact = c.join(r, (c["shape"] == r["shape"]) & (c["method"] == r["rm"])).select(c["file"], c["method"], c["path"], "route_file", "route_path")
    rest = c.join(r.select("shape", "rm").distinct(), (c["shape"] == r["shape"]) & (c["method"] == r["rm"]), "left_anti")
    loose = rest.join(r, "shape", "left").select("file", "method", "path", "route_file", "route_path")
    return exact.unionByName(loose)


def weighted_routes(routes: DataFrame, counts: DataFrame, impact: DataFrame) -> DataFrame:
    """``file, method, path, calls, dependents, weight``: ``weight = dependents * calls + dependents``. Calls of one shape add up."""
    n = counts.groupBy("method", route_shape(F.col("path")).alias("shape")).agg(F.sum("count").alias("calls"))
    joined = routes.withColumn("shape", route_shape(F.col("path"))).join(n, ["method", "shape"], "left").join(impact.select(F.col("id").alias("file"), "dependents"), "file", "left")
    calls_, deps = F.coalesce("calls", F.lit(0)), F.coalesce("dependents", F.lit(0))
    return joined.select("file", "method", "path", calls_.alias("calls"), deps.alias("dependents"), (deps * calls_ + deps).alias("weight"))


def unused(orphans: DataFrame, routes: DataFrame, counts: DataFrame) -> DataFrame:
    """``id, path, confidence`` of orphans none of whose routes was called: 0.9 with routes that stay silent, 0.6 without routes."""
    shaped = routes.select("file", "method", route_shape(F.col("path")).alias("shape"))
    hit = shaped.join(counts.select("method", route_shape(F.col("path")).alias("shape")).distinct(), ["method", "shape"], "left_semi").select(F.col("file").alias("id")).distinct()
    served = routes.select(F.col("file").alias("id")).distinct().withColumn("r", F.lit(True))
    return orphans.join(hit, "id", "left_anti").join(served, "id", "left").select("id", "path", F.when(F.col("r"), 0.9).otherwise(0.6).alias("confidence"))
