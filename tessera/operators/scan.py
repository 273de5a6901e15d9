"""Segmented prefix scans: what the rows before a row, in order and within its segment, come to.

Rows are elements of a monoid (``lift`` a symbol, ``join`` two elements; None is the neutral
one). They are dealt by ranges of segment and order, so a long segment is many tasks. Each
task joins what it has, row by row in one pass; the last segment of a task is summed up
as one element; the driver joins these sums (one a task) to what each task's first segment
brings along; and that is put before the rows of that segment without a further shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import tables


@dataclass(frozen=True)
class Monoid:
    """``lift``: a symbol (text) to an element; ``join``: two elements to one; ``show``: an element (None: nothing before) to the text that a row gets. Elements are JSON values."""

    lift: Callable[[str], Any]
    join: Callable[[Any, Any], Any]
    show: Callable[[Any], str]

    def both(self, a: Any, b: Any) -> Any:
        return b if a is None else a if b is None else self.join(a, b)


def _write(element: Any) -> str | None:
    return None if element is None else json.dumps(element, ensure_ascii=False)


def _read(text: str | None) -> Any:
    return None if text is None else json.loads(text)


def _local(m: Monoid):
    """The element of the rows before each row that are in its segment and in its task."""

    @F.pandas_udf("string")
    def local(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        segment, element, text = object(), None, None
        for segments, symbols in batches:
            out = []
            for s, x in zip(segments.tolist(), symbols.tolist(), strict=True):
                if s != segment:
                    segment, element, text = s, None, None
                out.append(text)
                if x is not None:
                    element = m.both(element, m.lift(x))
                    text = _write(element)
            yield pd.Series(out, dtype=object)

    return local.asNondeterministic()  # it depends on the order of rows: to be run where it stands


def _carries(m: Monoid, sums: list) -> dict[int, tuple[str | None, Any]]:
    """Of each task whose first segment began before it: that segment and the element of its rows so far."""
    out: dict[int, tuple[str | None, Any]] = {}
    last, total = object(), None
    for r in sorted(sums, key=lambda r: r["part"]):
        carry = total if r["first"] == last else None
        if carry is not None:
            out[r["part"]] = (r["first"], carry)
        total = m.both(_read(r["end"]["local"]), None if r["end"]["symbol"] is None else m.lift(r["end"]["symbol"]))
        if r["first"] == r["last"]:
            total = m.both(carry, total)
        last = r["last"]
    return out


def scan(rows: DataFrame, segment: str, order: str, symbol: Column, m: Monoid, name: str = "before", held: list[DataFrame] | None = None) -> DataFrame:
    """``rows`` with ``name``: what ``m`` shows of the rows before each, in ``order`` within ``segment``.

    Rows with a null symbol change nothing. Null segments are one segment. ``order`` should be
    unique within a segment; of rows that tie, each counts as before some others. The result
    reads a written table, which ``held`` gets, to be released when the result is no longer read.
    """
    own = [c for c in rows.columns if c != name]
    keyed = rows.select(*own, F.col(segment).cast("string").alias("_segment"), symbol.alias("_symbol"))
    dealt = keyed.repartitionByRange(F.col(segment), F.col(order)).sortWithinPartitions(segment, order)
    at = F.monotonically_increasing_id()
    found = tables.written(dealt.select("*", _local(m)(F.coalesce(F.concat(F.lit("="), "_segment"), F.lit("")), F.col("_symbol")).alias("_local"), at.alias("_at"), F.spark_partition_id().alias("_part")), "scan")
    if held is not None:
        held.append(found)
    end = F.struct(F.col("_local").alias("local"), F.col("_symbol").alias("symbol"))
    sums = found.groupBy(F.col("_part").alias("part")).agg(F.min_by("_segment", "_at").alias("first"), F.max_by("_segment", "_at").alias("last"), F.max_by(end, "_at").alias("end"))
    carries = _carries(m, sums.collect())  # one row a task

    @F.pandas_udf("string")
    def shown(parts: pd.Series, segments: pd.Series, local: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for p, s, x in zip(parts.tolist(), segments.tolist(), local.tolist(), strict=True):
            carry = carries.get(p)
            key = (p if carry is not None and carry[0] == s else None, x)
            if key not in known:
                known[key] = m.show(m.both(carry[1] if key[0] is not None else None, _read(x)))
            out.append(known[key])
        return pd.Series(out, dtype=object)

    return found.select(*own, shown("_part", "_segment", "_local").alias(name))


# --- code fences: maps between the states "none open", "``` open", "~~~ open" ----------------

MARKERS = ("", "```", "~~~")


def _fence_map(marker: str) -> list[int]:
    k = MARKERS.index(marker)
    return [k if s == 0 else 0 if s == k else s for s in range(3)]


FENCES = Monoid(_fence_map, lambda a, b: [b[s] for s in a], lambda x: MARKERS[0 if x is None else x[0]])


# --- headings: slots for levels 1 to 6, each kept, cleared or set, and the line of the last heading ---


def heading_symbol(level: Column, heading: Column, line: Column) -> Column:
    return F.to_json(F.struct(level.cast("int").alias("level"), heading.alias("heading"), line.cast("long").alias("line")))


def _heading_slots(symbol: str) -> list:
    h = json.loads(symbol)
    return [h["line"], *(None if k < h["level"] else h.get("heading", "") if k == h["level"] else False for k in range(1, 7))]


def _slots_after(a: list, b: list) -> list:
    return [b[0], *(x if y is None else y for x, y in zip(a[1:], b[1:], strict=True))]


def _slots_shown(x: list | None) -> str:
    """The line of the last heading and the open headings of levels 2 to 6, null where none is open."""
    x = x or [None] + [None] * 6
    return json.dumps({"line": x[0], "open": [v if isinstance(v, str) else None for v in x[2:]]}, ensure_ascii=False)


HEADINGS = Monoid(_heading_slots, _slots_after, _slots_shown)
