"""A portable bundle of derived tables: Parquet folders and a manifest with a digest of each table's content."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "0.1"


def digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order: count, and two sums of 64-bit row hashes."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count(F.lit(1)), half(1), half(17)).head()
    return f"{n}:{int(a or 0):x}:{int(b or 0):x}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save(path: str, tables: dict[str, DataFrame], notes: dict | None = None) -> None:
    """Writes the tables, then the manifest; a bundle without a manifest is not complete."""
    spark = next(iter(tables.values())).sparkSession
    told = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        told[name] = digest(spark.read.parquet(f"{path}/{name}"))
    fs, target = _fs(spark, f"{path}/manifest.json")
    out = fs.create(target, True)
    out.write(bytearray(json.dumps({"format": FORMAT, "tables": told, "notes": notes or {}}, sort_keys=True).encode()))
    out.close()


def load(spark: SparkSession, path: str, verify: bool = False) -> dict[str, DataFrame]:
    """The tables of a bundle; ``verify`` recomputes the digests and raises ValueError on a difference. Unknown formats are refused."""
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))
    if not str(manifest.get("format", "")).startswith("0.1"):
        raise ValueError(f"unknown format {manifest.get('format')!r}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    if verify:
        wrong = [n for n, df in tables.items() if digest(df) != manifest["tables"][n]]
        if wrong:
            raise ValueError(f"content differs from the manifest: {', '.join(wrong)}")
    return tables


def staleness(manifest_commit: str | None, head: str | None, ancestors: set[str], dirty: bool) -> str:
    """fresh, dirty, behind, diverged or unknown for a bundle made at a commit."""
    if not manifest_commit or not head:
        return "unknown"
    if manifest_commit == head:
        return "dirty" if dirty else "fresh"
    return "behind" if manifest_commit in ancestors else "diverged"
