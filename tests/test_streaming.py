"""Parity of a stream with a table: against sets, over stops and restarts."""

from __future__ import annotations

import datetime

import pytest

from tessera.streaming import parity

T0 = datetime.datetime(2024, 1, 1)
KINDS = "namespace string, id long, at timestamp"


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def run(spark, folder, expected, wait_ms):
    """All that has arrived by now, from the checkpoint on."""
    arrivals = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = parity.watch(arrivals, expected, wait_ms).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/log")
    q.awaitTermination(120)
    return {r["namespace"]: tuple(r)[1:] for r in parity.report(spark.read.schema(parity.LOG).parquet(f"{folder}/log"), expected).collect()}


@pytest.fixture
def expected(spark):
    rows = [("a", i) for i in range(40)] + [("b", i) for i in range(3)] + [("c", 1), ("never", 1), ("a", 5), ("b", None), (None, 1)]
    return parity.parted(spark.createDataFrame(rows, "namespace string, id long"), size=15).cache()


def put(spark, folder, rows):
    spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


FIRST = [("a", i, at(i % 5)) for i in range(25)] + [("b", 0, at(0)), ("b", 77, at(0)), ("b", 77, at(1)), ("other", 1, at(1)), (None, 1, at(1)), ("c", None, at(1)), ("b", 1, None)]
SECOND = [("a", i, at(6)) for i in range(20, 40)] + [("a", 99, at(6)), ("c", 1, at(7))]
THIRD = [("c", 1, at(500)), ("c", 50, at(500))]


def test_stream_that_stops_equals_one_that_does_not(spark, tmp_path, expected):
    """Repeated, unexpected and null ids; namespaces complete, timed out and without an arrival; parts of a namespace."""
    stops, whole = str(tmp_path / "s"), str(tmp_path / "w")
    put(spark, stops, FIRST)
    assert run(spark, stops, expected, 3_600_000) == {"a": ("waiting", 40, 25, 15, 0), "b": ("waiting", 3, 1, 2, 1), "c": ("waiting", 1, 0, 1, 0), "never": ("waiting", 1, 0, 1, 0)}
    put(spark, stops, SECOND)
    assert run(spark, stops, expected, 3_600_000)["c"] == ("complete", 1, 1, 0, 0)
    put(spark, stops, THIRD)
    last = run(spark, stops, expected, 3_600_000)
    assert last["b"] == ("timeout", 3, 1, 2, 1) and last["never"][0] == "waiting"
    assert last["a"][:4] == ("complete", 40, 40, 0)
    for rows in (FIRST, SECOND, THIRD):
        put(spark, whole, rows)
    assert run(spark, whole, expected, 3_600_000) == last


def test_nothing_arrives(spark, tmp_path, expected):
    put(spark, str(tmp_path), [])
    assert set(run(spark, str(tmp_path), expected, 1000).values()) == {("waiting", n, 0, n, 0) for n in (40, 3, 1)}
