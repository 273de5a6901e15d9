"""Runs of cases against a service: a ledger with one row an attempt, and the first model that will do."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.sources import versions

ATTEMPT = "attempt string, turn long, model string, case_id string, run int, status string, error string, seconds double, value string"


def planned(cases: DataFrame, models: list[str], runs: int = 1) -> DataFrame:
    """All attempts of cases (case_id, case_no): attempt (the key), turn, model, case_id, run, wave_no (the case's number).

    Models take turns in an order that is rotated by the run and the case's number, so each is
    first as often as the others. Rows that repeat a case_id are one case.
    """
    one = cases.where("case_id is not null").groupBy(F.col("case_id").cast("string").alias("case_id")).agg(F.min("case_no").alias("case_no"))
    each = F.array(*(F.struct(F.lit(r).alias("run"), F.lit(k).alias("k"), F.lit(m).alias("model")) for r in range(runs) for k, m in enumerate(models)))
    rows = one.select("case_id", "case_no", F.inline(each))
    n = len(models)
    place = F.pmod(F.col("k") - F.col("run") - F.col("case_no"), F.lit(n))
    return rows.select(F.to_json(F.struct("run", "model", "case_id")).alias("attempt"), ((F.col("run") * F.lit(1 << 40) + F.col("case_no")) * n + place).cast("long").alias("turn"), "model", "case_id", "run", "case_no")


def _tried(call: Callable[[str, str], object], clock: Callable[[], float], model: str, case: str) -> tuple:
    began = clock()
    try:
        value, status, error = call(model, case), "ok", None
    except Exception as e:  # becomes the row
        value, status, error = None, "error", type(e).__name__
    return status, error, float(clock() - began), None if value is None else str(value)


def attempted(pending: DataFrame, call: Callable[[str, str], object], at_once: int = 4, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """Rows of ATTEMPT: what ``call(model, case_id)`` gave for each pending attempt, or the kind of its error; an error ends no run. A partition has at most ``at_once`` calls under way and starts them in the order of their turns."""
    kinds = to_arrow_schema(StructType.fromDDL(ATTEMPT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                rows = batch.to_pydict()
                found = list(pool.map(lambda m, c: _tried(call, clock, m, c), rows["model"], rows["case_id"]))
                made = {k: [x[i] for x in found] for i, k in enumerate(("status", "error", "seconds", "value"))}
                yield pa.RecordBatch.from_pydict({k.name: (rows | made)[k.name] for k in kinds}, schema=kinds)

    return pending.select("attempt", "turn", "model", "case_id", "run").mapInArrow(run, ATTEMPT)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The attempts that a ledger holds."""
    if not versions.manifest_of(spark, root)["batches"]:
        return spark.createDataFrame([], ATTEMPT)
    return versions.read_keyed(spark, root, "attempt")


def run_cases(spark: SparkSession, root: str, cases: DataFrame, models: Iterable[str], call: Callable[[str, str], object], runs: int = 1, wave: int = 10_000, at_once: int = 4, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """Make all attempts that the ledger at ``root`` does not hold, and return it.

    Cases go in waves of about ``wave`` (by their numbers); a wave's results are committed
    together, so a run that is stopped is taken up at the wave where it stopped and the ledger
    holds each attempt once. ``call`` is sent to the workers.
    """
    plan = planned(cases, list(models), runs)
    last = plan.agg(F.max("case_no")).first()[0]
    for w in range(0 if last is None else last // wave + 1):
        part = plan.where(F.floor(F.col("case_no") / wave) == w)
        todo = part.join(ledger(spark, root).select(F.col("attempt").alias("done")), F.col("attempt") == F.col("done"), "left_anti")
        todo = todo.repartitionByRange("turn").sortWithinPartitions("turn")
        if not todo.isEmpty():
            versions.upsert(spark, root, attempted(todo, call, at_once, clock), "attempt")
    return ledger(spark, root)


def first_acceptable(candidates: DataFrame, by: str, order: str, item: str) -> DataFrame:
    """Of each group the first item, in order, that is ``ok``; null if none is, with the number tried before it."""
    g = candidates.groupBy(by).agg(F.min_by(F.when(F.col("ok"), F.col(item)), F.when(F.col("ok"), F.col(order))).alias("chosen"), F.min(F.when(F.col("ok"), F.col(order))).alias("_at"), F.count(F.lit(1)).alias("_n"))
    tried = candidates.join(g.select(F.col(by).alias("_by"), "_at"), F.col(by).eqNullSafe(F.col("_by"))).groupBy(F.col(by).alias("_b")).agg(F.count_if(F.col("_at").isNull() | (F.col(order) < F.col("_at"))).alias("rejected"))
    return g.join(tried, F.col(by).eqNullSafe(F.col("_b"))).select(by, "chosen", "rejected")


def probe(models: Iterable[str], live: Iterable[str], ask: Callable[[str, str], object], passage: str = "A synthetic passage: the sky is blue.") -> str | None:
    """The first model, in order of preference, that is live and answers a synthetic passage."""
    live = set(live)
    for model in models:
        if model in live:
            try:
                if ask(model, passage):
                    return model
            except Exception:  # the next one is tried
                continue
    return None
