"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import clean_path, first_segment
from tessella.operators.skew import missing_from

#: How a key with nulls is matched; see :func:`orphans`.
SEMANTICS = ("simple", "full", "partial", "leading")


def orphans(refs: DataFrame, targets: DataFrame, keys: Sequence[tuple[str, str]], match: str = "leading") -> DataFrame:
    """Rows of ``refs`` without a target, with ``null_mask`` (one letter a column: ``k`` known, ``n`` null).

    ``keys`` pairs each reference column with a target column. The references are grouped by their null mask, and
    each mask is anti-joined on the columns it knows. ``match`` declares what a null means: ``simple`` - a key with
    any null refers to nothing and is never an orphan; ``full`` - such a key is an orphan unless all its columns
    are null; ``partial`` - all known columns must match one target row; ``leading`` - the first known
    column decides. A key of nulls only is never an orphan. Repeated rows stay repeated, an empty target
    table makes every checked reference an orphan, and further columns pass through.
    """
    if match not in SEMANTICS:
        raise ValueError(f"match must be one of {SEMANTICS}")
    parts = []
    for mask in product((True, False), repeat=len(keys)):
        group = refs.where(reduce(lambda a, b: a & b, [F.col(r).isNotNull() if known else F.col(r).isNull() for (r, _), known in zip(keys, mask)]))
        known = [k for k, here in zip(keys, mask) if here]
        if not known or (match == "simple" and len(known) < len(keys)):
            continue
        if match == "full" and len(known) < len(keys):
            found = group
        else:
            used = known[:1] if match == "leading" else known
            if len(used) == 1:
                found = missing_from(group, used[0][0], targets, used[0][1])
            else:
                packed = group.withColumn("__key", F.to_json(F.struct(*[F.col(r).alias(f"k{i}") for i, (r, _) in enumerate(used)])))
                there = targets.dropna(subset=[t for _, t in used]).select(F.to_json(F.struct(*[F.col(t).alias(f"k{i}") for i, (_, t) in enumerate(used)])).alias("__there"))
                found = missing_from(packed, "__key", there, "__there").drop("__key")
        parts.append(found.withColumn("null_mask", F.lit("".join("k" if here else "n" for here in mask))))
    return reduce(DataFrame.unionByName, parts)


#: So many names are compared in place; more are joined.
MOST_NAMES = 10_000


def project_paths(rows: DataFrame, path: str, names: DataFrame) -> DataFrame:
    """Rows whose path has a ``/`` and one of ``names`` (``name``) as its first segment."""
    segment = F.when(F.col(path).contains("/"), first_segment(F.col(path)))
    listed = names.select(F.col("name").alias("__repo")).where(F.col("__repo").isNotNull()).distinct()
    known = [r[0] for r in listed.limit(MOST_NAMES + 1).collect()]
    return rows.where(segment.isin(known)) if len(known) <= MOST_NAMES else rows.join(listed, segment == F.col("__repo"), "left_semi")


def import_references(imports: DataFrame, repos: DataFrame) -> DataFrame:
    """Imports that refer to project files: ``import_id, ref_id, ref_path, resolved, indexed_at``.

    An import with a ``to_file_id`` refers by id; one without refers by its cleaned path if that is a project path, else to an outside package and is left out.
    Rows are taken as delivered: repeats are left to whoever counts.
    """
    known = imports.select(F.col("id").alias("import_id"), F.col("to_file_id").alias("ref_id"), clean_path(F.col("to_path")).alias("ref_path"), "resolved", "indexed_at")
    return known.where(F.col("ref_id").isNotNull()).unionByName(project_paths(known.where(F.col("ref_id").isNull()), "ref_path", repos))


def file_targets(files: DataFrame) -> DataFrame:
    """Every id and every cleaned path that ``files`` knows, whatever the delivery."""
    return files.select(F.col("id").alias("file_id"), clean_path(F.col("path")).alias("file_path"))


def import_orphans(imports: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """``import_id, ref_kind`` of each import whose project file is missing, once; ``ref_kind`` is ``id`` or ``path``.

    Repeats of an import are exact; should rows of one id differ, it is an orphan if any of them is. The orphans are few, so they are made distinct last.
    """
    lost = orphans(import_references(imports, repos), file_targets(files), [("ref_id", "file_id"), ("ref_path", "file_path")], "leading")
    return lost.select("import_id", F.when(F.col("null_mask").startswith("k"), "id").otherwise("path").alias("ref_kind")).distinct()


def orphan_report(imports: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """Per month of ``indexed_at`` and kind of key: references, orphans, and orphans that claim to be resolved; each import once.

    ``period`` is ``yyyy-MM`` or null; ``ref_kind`` is ``id`` or ``path``.
    """
    kind = F.when(F.col("ref_id").isNotNull(), "id").otherwise("path")
    refs = import_references(imports, repos).select("import_id", F.date_format("indexed_at", "yyyy-MM").alias("period"), kind.alias("ref_kind"), (F.col("resolved") == 1).alias("claimed")).distinct()
    lost = import_orphans(imports, files, repos).withColumn("lost", F.lit(True))
    told = refs.join(lost, ["import_id", "ref_kind"], "left")
    return told.groupBy("period", "ref_kind").agg(F.count(F.lit(1)).alias("references"), F.count("lost").alias("orphans"), F.count(F.when(F.col("lost") & F.col("claimed"), 1)).alias("claimed_resolved")).select(
        F.lit("imports").alias("table_name"), "period", "ref_kind", "references", "orphans", "claimed_resolved"
    )
