"""Sinks: tables, JSON lines, CSV, the vector table and published artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECRETS = r"(?i)(?:api[_-]?key|secret|password|token)\s*[=:]\s*\S{8,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----"


def write_table(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Parquet, all files or none (the committer renames at the end of the job)."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object a line; rows are in order across files. Nulls are written."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(fields).write.mode("overwrite").csv(path, header=True, lineSep="\n")


def upsert_vectors(spark: SparkSession, path: str, batch: DataFrame, namespace: str, key: str = "vec_id") -> int:
    """Write a batch into a namespace of a vector table; rows with its keys are replaced. Returns the number written.

    The batch alone is written, as a new version of the namespace; a failure leaves the old one.
    """
    from . import versions

    return versions.upsert(spark, f"{path}/namespace={namespace}", batch, key)


def read_vectors(spark: SparkSession, path: str, namespace: str, key: str = "vec_id", version: int | None = None) -> DataFrame:
    """A namespace as of a version, by default the newest."""
    from . import versions

    return versions.read_keyed(spark, f"{path}/namespace={namespace}", key, version)


def leaks(df: DataFrame) -> DataFrame:
    """Rows whose text columns hold something like a credential; a publication of them must stop."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(F.col(c).rlike(SECRETS), F.lit(False))
    return df.where(hit)
