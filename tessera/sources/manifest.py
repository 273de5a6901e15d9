"""Manifests: delimited files of strings, their checks, and the rules for source URLs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tessera.functions import text as T


class ContractError(ValueError):
    """An input does not have what its contract asks for."""


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header; every value a string without outer white space (of any kind), null empty.

    Values in quotes may hold line ends, and quotes that are doubled; a backslash is a character
    as any other. Raises ContractError if a column is missing or there are no rows. A
    byte-order mark is skipped by the reader.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    out = df.select([F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "").alias(c) for c in df.columns])
    if out.isEmpty():
        raise ContractError("no rows")
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str | Ty.StructType, array: bool = False) -> DataFrame:
    """JSON lines (or one top-level array) with a fixed schema; a malformed record fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", array).json(path)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Files as one string each: path, text. Bytes that are not UTF-8 fail the scan."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path"))).alias("text"))


def read_pinned(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """Binary files against a ledger (name, sha256): name, status ('ok', 'changed', 'unlisted', 'absent'), content."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"), "content")
    j = files.join(ledger.select("name", F.col("sha256").alias("pinned")), "name", "full_outer")
    status = F.when(F.col("found").isNull(), "absent").when(F.col("pinned").isNull(), "unlisted").when(F.col("found") != F.col("pinned"), "changed").otherwise("ok")
    return j.select("name", status.alias("status"), "content")


@F.pandas_udf(Ty.StringType())
def _by_charset(content: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes by the first that fits of the named charset, UTF-8 and Windows-1252, else UTF-8 with signs for what it can't read."""

    def text(data: bytes | None, name: str) -> str | None:
        if data is None:
            return None
        for codec in (name, "utf-8", "windows-1252"):
            try:
                return bytes(data).decode(codec)
            except (UnicodeDecodeError, LookupError):
                continue
        return bytes(data).decode("utf-8", "replace")

    return pd.Series([text(d, n or "utf-8") for d, n in zip(content, charset, strict=True)])


def decode_html(content: Column) -> Column:
    """Bytes as text: by the charset that the first 4096 bytes declare, else UTF-8, else Windows-1252.

    Valid UTF-8 that declares nothing else is decoded in the JVM; only other bytes go to Python.
    """
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    declared = F.lower(F.regexp_extract(head, r"(?i)charset\s*=\s*['\"]?([\w.-]+)", 1))
    as_text = content.cast("string")
    plain = declared.isin("", "utf-8", "utf8") & F.is_valid_utf8(as_text)
    return F.when(plain, as_text).otherwise(_by_charset(F.when(~plain, content), declared))


def validate(df: DataFrame, id_col: str, required: list[str], enums: dict, patterns: dict[str, str]) -> DataFrame:
    """One row of counts: rows, ids, blanks by column, values outside of an enumeration or pattern."""
    bad = [F.count_if(T.squeeze(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(f"blank_{c}") for c in required]
    for c, allowed in enums.items():
        if allowed is not None:
            bad.append(F.count_if(F.coalesce(~F.lower(c).isin(allowed), F.lit(True))).alias(f"bad_{c}"))
    for c, p in patterns.items():
        bad.append(F.count_if(F.coalesce(~F.col(c).rlike(p), F.lit(True))).alias(f"bad_{c}"))
    n, d = F.count(F.lit(1)), F.count_distinct(id_col)
    return df.agg(n.alias("n_rows"), d.alias("n_ids"), (n == d).alias("ids_unique"), *bad)


def require(report: DataFrame, zero: list[str], true: list[str] = ()) -> None:
    """Raise ContractError unless the counts are zero and the flags true; report: one row."""
    row = report.first()
    wrong = [c for c in zero if row[c]] + [c for c in true if not row[c]]
    if wrong:
        raise ContractError(f"contract broken: {', '.join(f'{c} = {row[c]}' for c in wrong)}")


def url_parts(url: Column, sites: list[str]) -> list[Column]:
    """host, allowed (https on one of ``sites``, no user, port 443) and source_key, equal for URLs of one source."""
    base = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
    scheme, auth, path = F.lower(F.regexp_extract(url, base, 1)), F.regexp_extract(url, base, 2), F.regexp_extract(url, base, 3)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(auth, "^.*@", ""), ":[0-9]*$", ""))
    port = F.regexp_extract(auth, ":([0-9]+)$", 1)
    on_site = F.lit(False)
    for s in sites:
        on_site = on_site | (host == s) | host.endswith("." + s)
    allowed = (scheme == "https") & ~F.contains(auth, F.lit("@")) & port.isin("", "443") & on_site
    key = T.sha256(F.concat_ws("\n", scheme, host, F.regexp_replace(path, "/+$", ""), query))
    return [host.alias("host"), allowed.alias("allowed"), key.alias("source_key")]
