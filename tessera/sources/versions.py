"""Sets of artifacts and keyed tables that change as a whole: immutable files, and one manifest a version.

Files are written under names of their own and never changed. A version is a manifest that
lists the files it is made of; it comes into being by one rename that fails if the version
exists. So a reader sees the old set or the new one, a writer that dies at any point leaves
files that no manifest lists (``vacuum`` removes them), and of two writers that began from the
same version the second is told.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import publish
from .manifest import ContractError
from .sinks import SECRETS, leaks
from .tables import file_system

MANIFESTS = "_versions"


class Conflict(RuntimeError):
    """Another writer has made the version in the meantime."""


def _listed(spark: SparkSession, path: str) -> list:
    p, fs = file_system(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def current(spark: SparkSession, root: str) -> int:
    """The number of the newest version; 0 if there is none."""
    found = (re.fullmatch(r"v(\d{8})\.json", s.getPath().getName()) for s in _listed(spark, f"{root}/{MANIFESTS}"))
    return max((int(m[1]) for m in found if m), default=0)


def manifest_of(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """version and what it lists: artifacts (name to file or table folder) and batches (folders of a keyed table, in order)."""
    version = current(spark, root) if version is None else version
    if not version:
        return {"version": 0, "artifacts": {}, "batches": []}
    data = publish.read_bytes(spark, f"{root}/{MANIFESTS}/v{version:08d}.json")
    if data is None:
        raise ContractError(f"{root} has no version {version}")
    return json.loads(data)


def _put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = file_system(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def _put_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def _rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename, but never onto a file that is there."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    a, b = fs.Path(source), fs.Path(target)
    context = fs.FileContext.getFileContext(a.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if a.toUri().getScheme() else fs.FileContext.getLocalFSFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    none[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
    try:
        context.rename(a, b, none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"{target} exists") from None
        raise


def commit(spark: SparkSession, root: str, base: int, artifacts: Mapping[str, str], batches: list[str]) -> int:
    """Make version ``base`` + 1 of these files. Raises Conflict if there is one already."""
    version = base + 1
    body = publish.canonical_json({"version": version, "artifacts": dict(artifacts), "batches": batches})
    part = f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}"
    _put_bytes(spark, part, body.encode())
    _rename_new(spark, part, f"{root}/{MANIFESTS}/v{version:08d}.json")
    return version


# --- sets of artifacts --------------------------------------------------------------------------


def publish_set(spark: SparkSession, root: str, artifacts: Mapping[str, str | bytes | DataFrame], secrets: Iterable[str] = (), base: int | None = None) -> int:
    """Publish artifacts (name: text, bytes or table) as one new version and return its number; those of the former version that are not named stay.

    Nothing is written if one holds a secret or something like a credential. ``base`` is the
    version that the artifacts were made from, by default the newest.
    """
    secrets = [s for s in secrets if s]
    for name, content in artifacts.items():
        if isinstance(content, DataFrame):
            held = not leaks(content).isEmpty()
            for c in (f.name for f in content.schema if secrets and f.dataType.simpleString() == "string"):
                held = held or not content.where(F.greatest(F.lit(False), *(F.coalesce(F.contains(c, F.lit(s)), F.lit(False)) for s in secrets))).isEmpty()
        else:
            text = content if isinstance(content, str) else content.decode("utf-8", "replace")
            held = any(s in text for s in secrets) or bool(re.search(SECRETS, text))
        if held:
            raise ContractError(f"{name} holds a credential")
    before = manifest_of(spark, root, base)
    listed = dict(before["artifacts"])
    for name, content in artifacts.items():
        listed[name] = f"data/{uuid.uuid4().hex}"
        if isinstance(content, DataFrame):
            _put_table(content, f"{root}/{listed[name]}")
        else:
            _put_bytes(spark, f"{root}/{listed[name]}", content.encode() if isinstance(content, str) else content)
    return commit(spark, root, before["version"], listed, before["batches"])


def read_artifact(spark: SparkSession, root: str, name: str, version: int | None = None) -> bytes:
    """The bytes of an artifact of a version, by default the newest."""
    listed = manifest_of(spark, root, version)["artifacts"]
    if name not in listed:
        raise ContractError(f"{root} has no {name}")
    return publish.read_bytes(spark, f"{root}/{listed[name]}")


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table artifact of a version."""
    return spark.read.parquet(f"{root}/{manifest_of(spark, root, version)['artifacts'][name]}")


# --- keyed tables ---------------------------------------------------------------------------------


def upsert(spark: SparkSession, root: str, batch: DataFrame, key: str, tries: int = 10) -> int:
    """Write a batch; rows with its keys are replaced when the table is read. Returns the number of rows written.

    Only the batch is written, once; if another writer commits first, the commit is tried again
    behind that one's batch. Null and repeated keys in a batch are errors.
    """
    folder = f"data/{uuid.uuid4().hex}"
    _put_table(batch, f"{root}/{folder}")
    stored = spark.read.schema(batch.schema).parquet(f"{root}/{folder}")
    wrong = stored.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    if not wrong.isEmpty():
        raise ContractError(f"a batch has null or repeated {key}")
    n = stored.count()
    for _ in range(tries):
        before = manifest_of(spark, root)
        try:
            commit(spark, root, before["version"], before["artifacts"], [*before["batches"], folder])
            return n
        except Conflict:
            continue
    raise Conflict(f"{root} changed {tries} times")


def read_keyed(spark: SparkSession, root: str, key: str, version: int | None = None) -> DataFrame:
    """The table as of a version: of each key the row of its last batch. One shuffle by key, combined before it."""
    batches = manifest_of(spark, root, version)["batches"]
    if not batches:
        raise ContractError(f"{root} has no batch")
    rows = None
    for i, b in enumerate(batches):
        one = spark.read.parquet(f"{root}/{b}").withColumn("_batch", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    if len(batches) == 1:
        return rows.drop("_batch")
    columns = [c for c in rows.columns if c not in (key, "_batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("_row")) if columns else rows.select(key).distinct()
    return last.select(key, *(F.col(f"_row.{c}").alias(c) for c in columns))


def compact(spark: SparkSession, root: str, key: str) -> int:
    """Write the table as one batch, as a new version. Batches that others commit meanwhile make this a Conflict."""
    before = manifest_of(spark, root)
    folder = f"data/{uuid.uuid4().hex}"
    _put_table(read_keyed(spark, root, key, before["version"]), f"{root}/{folder}")
    return commit(spark, root, before["version"], before["artifacts"], [folder])


def listing(spark: SparkSession, root: str, key: str, version: int | None = None) -> DataFrame:
    """The ids of a keyed table, in order."""
    return read_keyed(spark, root, key, version).select(key).orderBy(key)


def vacuum(spark: SparkSession, root: str, keep: int = 1, older_than_s: int = 86_400) -> list[str]:
    """Delete files that none of the last ``keep`` versions lists and that are older than that (younger ones may be of a commit under way); and older manifests. Returns the names."""
    newest, used, gone = current(spark, root), set(), []
    for v in range(max(1, newest - keep + 1), newest + 1):
        m = manifest_of(spark, root, v)
        used |= {*m["artifacts"].values(), *m["batches"]}
    limit = spark.sparkContext._jvm.System.currentTimeMillis() - older_than_s * 1000
    for folder in ("data", MANIFESTS):
        for s in _listed(spark, f"{root}/{folder}"):
            name = s.getPath().getName()
            m = re.fullmatch(r"v(\d{8})\.json", name)
            kept = f"data/{name}" in used if folder == "data" else bool(m) and int(m[1]) > newest - keep
            if not kept and s.getModificationTime() <= limit:
                p, fs = file_system(spark, f"{root}/{folder}/{name}")
                fs.delete(p, True)
                gone.append(f"{folder}/{name}")
    return gone
