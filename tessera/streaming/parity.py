"""Waiting until a namespace shows all ids that it should: a stream of arrivals against a table of expected ids.

The state is kept by namespace and part (a hash of the id; a part has about PART expected ids),
so no namespace is one state, and a part is looked at only when something arrives for it or
its time is over. Each change is one row of a log; ``report`` reads from the log how each
namespace stands. A stream that stops goes on from its checkpoint, and the log is the same
as that of a stream that did not stop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PART = 10_000
LOG = "namespace string, part int, seq long, status string, expected long, seen long, extra long"
STATE = "seq long, status string, deadline long, seen array<string>, extra array<string>"


def parted(expected: DataFrame, size: int = PART) -> DataFrame:
    """Expected ids (namespace, id as text) with the parts of their namespace, the part of the id and the number of ids in that part."""
    ids = expected.select(F.col("namespace").cast("string").alias("namespace"), F.col("id").cast("string").alias("id")).where("namespace is not null and id is not null").distinct()
    parts = ids.groupBy(F.col("namespace").alias("n")).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    j = ids.join(parts, F.col("namespace") == F.col("n")).drop("n").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    counts = j.groupBy(F.col("namespace").alias("n"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("in_part"))
    return j.join(counts, (F.col("namespace") == F.col("n")) & (F.col("part") == F.col("p"))).drop("n", "p")


def _advance(wait_ms: int):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, status, deadline, seen, extra = state.get if state.exists else (0, "waiting", 0, [], [])
        seen, extra, n = set(seen), set(extra), key[2]
        if state.hasTimedOut:
            status = "timeout"
        else:
            first = None
            for rows in batches:
                here = rows["at"].min()
                first = here if first is None else min(first, here)
                if status == "waiting":
                    seen.update(rows.loc[rows["wanted"], "id"])
                    extra.update(rows.loc[~rows["wanted"], "id"])
            deadline = deadline or int(first.timestamp() * 1000) + wait_ms
            status = "complete" if status == "waiting" and len(seen) == n else status
        state.update((seq + 1, status, deadline, sorted(seen), sorted(extra)))
        if status == "waiting":
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"namespace": [key[0]], "part": [key[1]], "seq": [seq + 1], "status": [status], "expected": [n], "seen": [len(seen)], "extra": [len(extra)]})

    return advance


def watch(arrivals: DataFrame, expected: DataFrame, wait_ms: int, late: str = "1 minute") -> DataFrame:
    """The log of a stream of arrivals (namespace, id, at timestamp) against ``parted`` ids: a row for each change of a part.

    A part is complete when all its ids have arrived, and times out ``wait_ms`` of event time
    after its first arrival; both are final. Ids that arrive again count once; ids that are
    not expected are counted as extra (in the part of their hash); namespaces of which
    nothing is expected are left out. Rows later than the watermark are dropped.
    """
    a = arrivals.select(F.col("namespace").cast("string").alias("ns"), F.col("id").cast("string").alias("key"), "at").withWatermark("at", late)
    parts = expected.select(F.col("namespace").alias("of"), "parts").distinct()
    a = a.join(parts, F.col("ns") == F.col("of")).withColumn("bin", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    sizes = expected.select(F.col("namespace").alias("s_ns"), F.col("part").alias("s_part"), "in_part").distinct()
    known = expected.select("namespace", "id", F.lit(True).alias("known"))
    a = a.join(sizes, (F.col("ns") == F.col("s_ns")) & (F.col("bin") == F.col("s_part")))
    a = a.join(known, (F.col("ns") == F.col("namespace")) & (F.col("key") == F.col("id")), "left")
    rows = a.select(F.col("ns").alias("namespace"), F.col("bin").alias("part"), F.col("in_part").alias("n"), F.col("key").alias("id"), "at", F.coalesce("known", F.lit(False)).alias("wanted")).where("id is not null and at is not null")
    return rows.groupBy("namespace", "part", "n").applyInPandasWithState(_advance(wait_ms), LOG, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def report(log: DataFrame, expected: DataFrame) -> DataFrame:
    """namespace, status, expected, seen, missing, extra: the last word of each part, summed up; ``expected`` as from ``parted``. A part without a word waits."""
    last = log.groupBy(F.col("namespace").alias("l_ns"), F.col("part").alias("l_part")).agg(F.max_by(F.struct("status", "seen", "extra"), "seq").alias("last"))
    parts = expected.select("namespace", "part", "in_part").distinct()
    j = parts.join(last, (F.col("namespace") == F.col("l_ns")) & (F.col("part") == F.col("l_part")), "left")
    seen, extra = F.coalesce("last.seen", F.lit(0)), F.coalesce("last.extra", F.lit(0))
    status = F.coalesce("last.status", F.lit("waiting"))
    g = j.groupBy("namespace").agg(F.sum("in_part").alias("expected"), F.sum(seen).alias("seen"), F.sum(extra).alias("extra"), F.bool_and(status == "complete").alias("all"), F.bool_or(status == "timeout").alias("late"))
    word = F.when(F.col("all"), "complete").when(F.col("late"), "timeout").otherwise("waiting")
    return g.select("namespace", word.alias("status"), "expected", "seen", (F.col("expected") - F.col("seen")).alias("missing"), "extra")
