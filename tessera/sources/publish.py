"""Publication of artifacts: single files written whole, reports, and sets of artifacts that appear together or not at all."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .manifest import ContractError
from .sinks import SECRETS


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces; characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A file's bytes; None if there is none."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file with its whole content or none: written under another name, then renamed."""
    p, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        fs.delete(part, False)
        raise OSError(f"could not write {path}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n")


def markdown_table(rows: DataFrame, order: list[str], title: str, most: int = 200) -> str:
    """A report's table of at most ``most`` rows (a report is for reading; more are counted below it)."""
    found = rows.orderBy(*order).limit(most + 1).collect()

    def cell(v: object) -> str:
        return ("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)).replace("|", r"\|").replace("\n", " ")

    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in found[:most]]
    return "\n".join([*lines, *(["", f"More than {most} rows; the first are shown."] if len(found) > most else []), ""])


def publish(spark: SparkSession, folder: str, artifacts: Mapping[str, str | bytes], secrets: Iterable[str] = ()) -> list[str]:
    """Write all artifacts (name: content) to a folder, or leave the folder as it was.

    Nothing is written if a content holds a secret or something like a credential. If a write
    fails, files that were there get their former bytes back and new ones go.
    """
    for name, content in artifacts.items():
        text = content if isinstance(content, str) else content.decode("utf-8", "replace")
        if any(s and s in text for s in secrets) or re.search(SECRETS, text):
            raise ContractError(f"{name} holds a credential")
    before = {name: read_bytes(spark, f"{folder}/{name}") for name in artifacts}
    done: list[str] = []
    try:
        for name, content in artifacts.items():
            done.append(name)
            write_bytes(spark, f"{folder}/{name}", content.encode("utf-8") if isinstance(content, str) else content)
    except BaseException:
        for name in done:
            if before[name] is None:
                p, fs = _fs(spark, f"{folder}/{name}")
                fs.delete(p, False)
            else:
                write_bytes(spark, f"{folder}/{name}", before[name])
        raise
    return [f"{folder}/{name}" for name in artifacts]
