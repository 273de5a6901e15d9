"""Contracts of inputs: exact records, registries, configuration, files, measured values, vector tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

from .manifest import ContractError


def records(df: DataFrame, id_col: str, fields: Iterable[str], ids: Iterable[str] | None = None, counts: Mapping[str, Mapping[str, int]] | None = None, blank_when: Mapping[str, Column] | None = None, distinct_text: str | None = None) -> list[str]:
    """What a table of records breaks of its contract, as messages.

    fields: its columns, no more and no less; ids: its ids, each once; counts: rows by value
    of a column; blank_when: columns that are null exactly where a condition holds;
    distinct_text: a column whose texts differ in more than white space and case. The driver
    gets counts and at most the expected ids.
    """
    wrong = []
    if sorted(df.columns) != sorted(fields):
        return [f"columns are {sorted(df.columns)}"]
    if ids is not None:
        ids = list(ids)
        known = df.where(F.col(id_col).isin(ids)).groupBy(id_col).count().collect()
        wrong += [f"{id_col} {r[0]} occurs {r[1]} times" for r in known if r[1] != 1]
        wrong += [f"{id_col} {i} is missing" for i in ids if i not in {r[0] for r in known}]
        others = df.where(~F.coalesce(F.col(id_col).isin(ids), F.lit(False))).count()
        wrong += [f"{others} rows have other ids"] * (others > 0)
    for column, wanted in (counts or {}).items():
        found = {r[0]: r[1] for r in df.where(F.col(column).isin(list(wanted))).groupBy(column).count().collect()}
        wrong += [f"{column} {v}: {found.get(v, 0)} rows instead of {n}" for v, n in wanted.items() if found.get(v, 0) != n]
        others = df.where(~F.coalesce(F.col(column).isin(list(wanted)), F.lit(False))).count()
        wrong += [f"{others} rows have another {column}"] * (others > 0)
    for column, condition in (blank_when or {}).items():
        n = df.where(F.col(column).isNull() != F.coalesce(condition, F.lit(False))).count()
        wrong += [f"{column} is null in the wrong {n} rows"] * (n > 0)
    if distinct_text:
        n = df.groupBy(T.casefold(T.squeeze_all(F.col(distinct_text))).alias("t")).count().where("count > 1").count()
        wrong += [f"{n} texts of {distinct_text} repeat"] * (n > 0)
    return wrong


def catalog(df: DataFrame, unique: Iterable[str], values: Mapping[str, str], prefixes: Mapping[str, str], n: int, files: str | None = None, suffix: str = ".pdf") -> list[str]:
    """What a catalogue of ``n`` rows breaks of its contract, as messages.

    Its columns are those named here, no more and no less. unique: columns that are neither blank
    nor repeated; values: columns with one value; prefixes: columns that begin so; files: a
    column of plain file names with this suffix (of any case).
    """
    unique, n_rows = list(unique), df.count()
    named = {*unique, *values, *prefixes, *([files] if files else [])}
    if set(df.columns) != named:
        return [f"columns are {sorted(df.columns)}"]
    wrong = [f"{n_rows} rows instead of {n}"] * (n_rows != n)
    for c in unique:
        bad = df.groupBy(F.trim(c).alias("v")).count().where((F.col("count") > 1) | F.coalesce(F.col("v") == "", F.lit(True))).count()
        wrong += [f"{c} is blank or repeated"] * (bad > 0)
    rules = {c: F.col(c) == v for c, v in values.items()} | {c: F.startswith(F.trim(c), F.lit(p)) for c, p in prefixes.items()}
    for c, rule in rules.items():
        bad = df.where(~F.coalesce(rule, F.lit(False))).count()
        wrong += [f"{c} is wrong in {bad} rows"] * (bad > 0)
    if files:
        fine = F.col(files).rlike(r"^[^/\\\x00]+$") & ~F.col(files).isin(".", "..") & F.endswith(F.lower(files), F.lit(suffix))
        bad = df.where(~F.coalesce(fine, F.lit(False))).count()
        wrong += [f"{files} is no file name in {bad} rows"] * (bad > 0)
    return wrong


def heading_registry(chunks: DataFrame, strategy: str = "heading_220_40", size: int = 220, overlap: int = 40) -> DataFrame:
    """Rows of a registry of section chunks that break its rules, with the rule's name: ids and digests derived anew, spans, totals, overlaps.

    chunks: doc, section_index, subchunk_index, subchunk_total, token_start, token_end, token_count, text, text_sha256, chunk_id.
    """
    w = W.partitionBy("doc", "section_index")
    c = chunks.select("*", F.count(F.lit(1)).over(w).alias("_n"), F.lag("token_end").over(w.orderBy("subchunk_index")).alias("_before"), (F.row_number().over(w.orderBy("subchunk_index")) - 1).alias("_place"))
    digest = T.sha256(F.col("text"))
    rules = {
        "text_sha256": digest != F.col("text_sha256"),
        "chunk_id": T.section_chunk_id(F.col("doc"), strategy, F.col("section_index"), F.col("subchunk_index"), digest) != F.col("chunk_id"),
        "token_count": ~F.col("token_count").between(1, size),
        "span": F.col("token_end") - F.col("token_start") != F.col("token_count"),
        "subchunk_index": F.col("_place") != F.col("subchunk_index"),
        "subchunk_total": F.col("_n") != F.col("subchunk_total"),
        "overlap": F.col("_before").isNotNull() & (F.col("token_start") != F.col("_before") - overlap),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True) if k != "overlap" else F.lit(False)), k) for k, bad in rules.items())))
    return c.select("doc", "section_index", "subchunk_index", F.explode(broken).alias("rule"))


def same_configuration(config: Mapping, pinned: Mapping, free: Iterable[str] = ()) -> None:
    """Raise ContractError unless every key but the free ones has its pinned value."""
    keys = (set(config) | set(pinned)) - set(free)
    wrong = sorted(k for k in keys if k not in config or k not in pinned or config[k] != pinned[k])
    if wrong:
        raise ContractError(f"configuration differs in {', '.join(wrong)}")


def safe_name(name: str, suffix: str = "") -> str:
    """The last part of an uploaded file's name; raises ContractError if it is empty, hidden or has another suffix."""
    base = PurePosixPath(name.replace("\\", "/")).name
    base = re.sub(r"[\x00-\x1f]", "", base).strip()
    if not base or base.startswith(".") or (suffix and not base.lower().endswith(suffix)):
        raise ContractError(f"not a usable file name: {name!r}")
    return base


def child(parent: str, name: str) -> str:
    """The path of a file directly in a folder; raises ContractError if links or dots lead out of it."""
    folder = Path(parent).resolve()
    path = (folder / name).resolve()
    if path.parent != folder:
        raise ContractError(f"{name!r} is not in {parent}")
    return str(path)


def outside(path: str, project: str) -> str:
    """The path of a file with secrets; raises ContractError if it is in the project."""
    found = Path(path).resolve()
    if found.is_relative_to(Path(project).resolve()):
        raise ContractError("a file with secrets must not be in the project")
    return str(found)


def settings(names: Iterable[str], environment: Mapping[str, str], file: str | None = None, project: str = ".") -> dict[str, str]:
    """Settings by name from the environment, else from lines NAME=value of a file outside the project; raises ContractError naming those that are missing."""
    known = {}
    if file is not None:
        for line in Path(outside(file, project)).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.partition("=")
            if eq and not line.lstrip().startswith("#"):
                known[name.strip()] = value.strip().strip("'\"")
    known |= {k: v for k, v in environment.items() if v}
    missing = [n for n in names if not known.get(n)]
    if missing:
        raise ContractError(f"missing settings: {', '.join(missing)}")
    return {n: known[n] for n in names}


def measured(found: DataFrame, pinned: Mapping[str, float], tolerance: float = 1e-9) -> list[str]:
    """Metrics (name, value) that are missing, repeated or off their pinned values; at most a row a pinned name reaches the driver."""
    rows = found.where(F.col("name").isin(list(pinned))).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("v")).collect()
    by = {r["name"]: r for r in rows}
    return [f"{k}: {by[k]['v'] if k in by else 'missing'} instead of {v}" for k, v in pinned.items() if k not in by or by[k]["n"] != 1 or by[k]["v"] is None or not abs(by[k]["v"] - v) <= tolerance]


def vector_table(vectors: DataFrame, dimension: int, expected: int | None = None, key: str = "vec_id", vector: str = "embedding") -> None:
    """Raise ContractError unless ids are unique, vectors have the dimension and finite numbers, and there are as many as expected."""
    from tessera.operators.vector import is_valid

    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_valid(F.col(vector), dimension)).alias("bad"), F.count_if(F.col(key).isNull()).alias("no_id")).first()
    twice = vectors.groupBy(key).count().where("count > 1").limit(1).count()
    wrong = [f"{row['bad']} vectors are not of {dimension} finite numbers"] * (row["bad"] > 0) + ["ids repeat"] * twice + [f"{row['no_id']} rows have no id"] * (row["no_id"] > 0)
    wrong += [f"{row['n']} rows instead of {expected}"] * (expected is not None and row["n"] != expected)
    if wrong:
        raise ContractError("; ".join(wrong))
