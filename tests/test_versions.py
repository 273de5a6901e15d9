"""Versions: whole or not at all, whatever step a writer dies at."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks, versions
from tessera.sources.manifest import ContractError


class Killed(BaseException):
    """The driver dies: no handler of the library catches it."""


@pytest.fixture
def killer(monkeypatch):
    """Let the n-th of all writes and renames die, before or after it took effect."""

    def arm(n, after):
        left = [n]

        def wrap(f):
            def run(*a):
                left[0] -= 1
                if left[0] < 0 and not after:
                    raise Killed
                f(*a)
                if left[0] < 0:
                    raise Killed

            return run

        for name in ("_put_bytes", "_put_table", "_rename_new"):
            monkeypatch.setattr(versions, name, wrap(getattr(versions, name)))

    yield arm
    monkeypatch.undo()


def seen(spark, root):
    names = versions.manifest_of(spark, root)["artifacts"]
    return {n: sorted(r["x"] for r in versions.read_table(spark, root, n).collect()) if n == "t" else versions.read_artifact(spark, root, n).decode() for n in names}


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("step", range(5))
def test_a_killed_publication_is_whole_or_absent(spark, tmp_path, killer, monkeypatch, step, after):
    root = str(tmp_path / "p")
    old = {"a.md": "one", "b.json": "{}", "t": [1]}
    assert versions.publish_set(spark, root, {"a.md": "one", "b.json": b"{}", "t": spark.createDataFrame([(1,)], "x int")}) == 1
    killer(step, after)
    with pytest.raises(Killed):
        versions.publish_set(spark, root, {"a.md": "two", "c.md": "three", "t": spark.createDataFrame([(2,)], "x int")})
    monkeypatch.undo()
    new = {"a.md": "two", "b.json": "{}", "c.md": "three", "t": [2]}
    assert seen(spark, root) == (new if step == 4 and after else old)
    versions.publish_set(spark, root, {"a.md": "two", "c.md": "three", "t": spark.createDataFrame([(2,)], "x int")})
    assert seen(spark, root) == new
    versions.vacuum(spark, root, older_than_s=-10)
    assert seen(spark, root) == new


def test_conflicts_secrets_and_old_versions(spark, tmp_path):
    root = str(tmp_path / "p")
    versions.publish_set(spark, root, {"a": "one"})
    versions.publish_set(spark, root, {"a": "two"}, base=1)
    with pytest.raises(versions.Conflict):
        versions.publish_set(spark, root, {"a": "three"}, base=1)
    assert versions.read_artifact(spark, root, "a") == b"two" and versions.read_artifact(spark, root, "a", 1) == b"one"
    for bad in ({"c": "api_key = 0123456789abcdef"}, {"c": "x sesame y"}, {"c": spark.createDataFrame([("a sesame",)], "s string")}):
        with pytest.raises(ContractError):
            versions.publish_set(spark, root, {"d": "fine"} | bad, ["sesame"])
    assert versions.current(spark, root) == 2
    with pytest.raises(ContractError):
        versions.read_artifact(spark, root, "nothing")
    assert versions.vacuum(spark, root) == []
    assert len(versions.vacuum(spark, root, keep=1, older_than_s=-10)) >= 2
    with pytest.raises(ContractError):
        versions.read_artifact(spark, root, "a", 1)


def rows(df):
    return {r["vec_id"]: tuple(r["embedding"]) for r in df.collect()}


def test_upserts_merge_on_read(spark, tmp_path):
    path, kinds = str(tmp_path / "v"), "vec_id long, embedding array<double>"
    with pytest.raises(ContractError):
        sinks.read_vectors(spark, path, "n")
    first = spark.createDataFrame([(1, [1.0]), (2, [2.0])], kinds)
    assert sinks.upsert_vectors(spark, path, first, "n") == 2
    assert sinks.upsert_vectors(spark, path, spark.createDataFrame([(2, [9.0]), (3, [3.0])], kinds), "n") == 2
    assert sinks.upsert_vectors(spark, path, first.where("false"), "n") == 0
    want = {1: (1.0,), 2: (9.0,), 3: (3.0,)}
    assert rows(sinks.read_vectors(spark, path, "n")) == want and rows(sinks.read_vectors(spark, path, "n", version=1)) == {1: (1.0,), 2: (2.0,)}
    root = f"{path}/namespace=n"
    assert versions.compact(spark, root, "vec_id") == 4 and rows(sinks.read_vectors(spark, path, "n")) == want
    assert [r[0] for r in versions.listing(spark, root, "vec_id").collect()] == [1, 2, 3]
    for bad in ([(1, [1.0]), (1, [2.0])], [(None, [1.0])]):
        with pytest.raises(ContractError):
            sinks.upsert_vectors(spark, path, spark.createDataFrame(bad, kinds), "n")
    assert rows(sinks.read_vectors(spark, path, "n")) == want


@pytest.mark.parametrize("step", range(3))
def test_a_killed_upsert_leaves_the_old_version(spark, tmp_path, killer, monkeypatch, step):
    path, kinds = str(tmp_path / "v"), "vec_id long, embedding array<double>"
    killer(step, False)
    with pytest.raises(Killed):
        sinks.upsert_vectors(spark, path, spark.createDataFrame([(1, [5.0])], kinds), "n")
    monkeypatch.undo()
    sinks.upsert_vectors(spark, path, spark.createDataFrame([(1, [1.0])], kinds), "n")
    assert rows(sinks.read_vectors(spark, path, "n")) == {1: (1.0,)}


def test_two_writers_both_land(spark, tmp_path, monkeypatch):
    root, kinds = str(tmp_path / "v"), "vec_id long, x double"
    versions.upsert(spark, root, spark.createDataFrame([(1, 1.0)], kinds), "vec_id")
    plain, other = versions.commit, [spark.createDataFrame([(2, 2.0)], kinds)]

    def late(*a):
        if other:
            monkeypatch.setattr(versions, "commit", plain)
            versions.upsert(spark, root, other.pop(), "vec_id")
        return plain(*a)

    monkeypatch.setattr(versions, "commit", late)
    versions.upsert(spark, root, spark.createDataFrame([(3, 3.0)], kinds), "vec_id")
    assert {r["vec_id"] for r in versions.read_keyed(spark, root, "vec_id").collect()} == {1, 2, 3}
    assert versions.read_keyed(spark, root, "vec_id").agg(F.sum("x")).first()[0] == 6
