"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: White-space normalisation and tokens as DuckDB writes them.
SQ = r"trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def squeeze_sql(column: str) -> str:
    return SQ.format(column)


def tokens_sql(column: str) -> str:
    s = squeeze_sql(column)
    return f"CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, ' ') END"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
