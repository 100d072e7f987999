"""Relational roll-ups of files, edges, symbols and errors: counts, orphans, histograms, top lists per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """Rows that match every argument that is not None; a list means any of its values."""
    tests = [F.col(c).isin(v) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def contains_any_case(columns: Sequence[str], text: str) -> Column:
    """Whether any of the columns holds ``text``, case aside; null holds nothing."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)), F.lit("")).contains(text.lower()) for c in columns])


def below_prefix(column: str, prefix: str) -> Column:
    """Equal to ``prefix``, or below it as a path, case aside."""
    return (F.col(column) == prefix) | F.lower(column).startswith(prefix.lower() + "/")


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**/`` any folders, ``**`` anything, ``*`` within a segment, ``?`` one character."""
    out, i = [], 0
    while i < len(glob):
        for mark, part in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(mark, i):
                out.append(part)
                i += len(mark)
                break
        else:
            out.append(("\\" if not glob[i].isalnum() and glob[i] not in "_/" else "") + glob[i])
            i += 1
    return "^" + "".join(out) + "$"


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. ``order`` must be total, or ties are cut at will. Spark cuts each map's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def share_of_group(counts: DataFrame, group: Sequence[str], count: str = "n", share: str = "share") -> DataFrame:
    """``counts`` with each row's part of its group's total."""
    return counts.withColumn(share, F.col(count) / F.sum(count).over(Window.partitionBy(*group)))


def leading_value(counts: DataFrame, group: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """``group, value, count, total, share``: the most frequent value of each group; the least value wins a tie."""
    best = F.max_by(F.struct(value, count), F.struct(F.col(count), F.lit(0))).alias("b")
    ranked = counts.groupBy(*group, count).agg(F.min(value).alias(value))
    totals = counts.groupBy(*group).agg(F.sum(count).alias("total"))
    top = ranked.groupBy(*group).agg(best)
    return top.join(totals, list(group)).select(*group, F.col("b").getField(value).alias(value), F.col("b").getField(count).alias(count), "total", (F.col("b").getField(count) / F.col("total")).alias("share"))


def orphans(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that nobody imports, self-imports aside."""
    return files.join(edges.where("src <> dst").select(F.col("dst").alias("id")), "id", "left_anti")


def entry_points(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that import others and are imported by none."""
    return orphans(files, edges).join(edges.where("src <> dst").select(F.col("src").alias("id")), "id", "left_semi")


def domain_summary(files: DataFrame, symbols: DataFrame, models: DataFrame) -> DataFrame:
    """``domain, files, symbols, models``: children are counted per file first, so one domain's rows never meet in one task."""
    owner = files.where("domain is not null").select("id", "domain")
    one = F.count(F.lit(1))
    sizes = owner.groupBy("domain").agg(one.alias("files"))
    per = lambda child, name: child.groupBy(F.col("file_id").alias("id")).agg(one.alias("n")).join(owner, "id").groupBy("domain").agg(F.sum("n").alias(name))
    out = sizes.join(per(symbols, "symbols"), "domain", "left").join(per(models, "models"), "domain", "left")
    return out.select("domain", "files", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("symbols", "models")])


def error_rollup(errors: DataFrame) -> DataFrame:
    """``file_id, errors, phases, sample``: rows per file, its distinct phases in order, the newest message."""
    return errors.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("errors"), F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases"), F.max_by("error_message", F.struct("ts", "id")).alias("sample")
    )


def domain_links(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``domain, files, intra, outgoing, incoming, cohesion`` from one pass over the edges' domain pairs."""
    owner = files.where("domain is not null").select("id", "domain")
    pairs = (
        edges.where("src <> dst")
        .join(owner.select(F.col("id").alias("src"), F.col("domain").alias("a")), "src")
        .join(owner.select(F.col("id").alias("dst"), F.col("domain").alias("b")), "dst")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    zero = F.lit(0).cast("long")
    sides = (
        pairs.where("a = b").select(F.col("a").alias("domain"), F.col("n").alias("intra"), zero.alias("outgoing"), zero.alias("incoming"))
        .unionByName(pairs.where("a <> b").select(F.col("a").alias("domain"), zero.alias("intra"), F.col("n").alias("outgoing"), zero.alias("incoming")))
        .unionByName(pairs.where("a <> b").select(F.col("b").alias("domain"), zero.alias("intra"), zero.alias("outgoing"), F.col("n").alias("incoming")))
    )
    sums = sides.groupBy("domain").agg(*[F.sum(c).alias(c) for c in ("intra", "outgoing", "incoming")])
    sizes = owner.groupBy("domain").agg(F.count(F.lit(1)).alias("files"))
    total = F.col("intra") + F.col("outgoing") + F.col("incoming")
    return sizes.join(sums, "domain", "left").select("domain", "files", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("intra", "outgoing", "incoming")]).withColumn("cohesion", F.when(total > 0, F.col("intra") / total))


def import_packages(imports: DataFrame, repos: DataFrame) -> DataFrame:
    """``package, imports, importers`` of outside packages: the key is taken from the path, so the prefix join is an equi-join.

    A scoped package keeps two segments; paths of project files are left out.
    """
    segment = F.substring_index("path", "/", 1)
    package = F.when(F.col("path").startswith("@"), F.substring_index("path", "/", 2)).otherwise(segment)
    outside = imports.where("path is not null and dst is null").withColumn("__s", segment).join(repos.select(F.col("name").alias("__s")).distinct(), "__s", "left_anti")
    return outside.groupBy(package.alias("package")).agg(F.count(F.lit(1)).alias("imports"), F.count_distinct("src").alias("importers"))
