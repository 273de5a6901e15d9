"""URL filter lists with a history: an as-of join of captures against dated entries.

A list is a table of dated entries: at ``listed_at`` the pattern gets an action (block or
allow), which holds until the pattern's next entry. Entries thus become validity
intervals; every capture is judged by the entries that were active when it was fetched.

A pattern is a host (which also covers its subdomains) or host/first-path-segment. Of the
active entries that match a capture the most specific decides. The join is on pattern and
period of 30 days since the epoch, which no time zone moves: intervals are split at the
periods that captures have and the captures' keys carry theirs, so a host that holds a
third of all captures is spread over its periods and, beyond that, split by adaptive
execution. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
PERIOD = 30 * 86400
PATH1 = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute URL, of an IPv6 address with its brackets; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def keys_of(url: Column) -> Column:
    """Patterns that can match a URL, the most specific first: host/segment, host, parent domains."""
    host, segment = host_of(url), F.regexp_extract(url, PATH1, 1)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.when(segment != "", F.array(F.concat_ws("/", host, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(path, parents))


def validity(entries: DataFrame) -> DataFrame:
    """Entries (pattern, listed_at, action) as intervals [valid_from, valid_to); the last one is open (null).

    Entries without a pattern, date or action say nothing and are left out; of several at
    the same moment block wins.
    """
    known = entries.where("pattern is not null and listed_at is not null and action is not null")
    one = known.groupBy("pattern", "listed_at").agg(F.max("action").alias("action"))  # 'block' > 'allow'
    return one.select("pattern", "action", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(W.partitionBy("pattern").orderBy("listed_at")).alias("valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame, horizon: tuple[str, str] | None = None) -> DataFrame:
    """Judge captures (page_id, url, fetch_time) by the entries active at fetch time.

    Every capture meets the entries active at its time, whenever that is; ``horizon`` (the
    months in which captures are expected) limits nothing. Captures without a time or
    without a host are kept. Returns one row per distinct capture: page_id, url,
    fetch_time, n_rows (repeated rows), host, matched (the deciding pattern or null),
    action (null if none is active) and kept (not blocked).
    """
    period = lambda t: F.floor(F.unix_seconds(t) / PERIOD)
    seen = captures.groupBy("page_id", "url", "fetch_time").agg(F.count(F.lit(1)).alias("n_rows"))
    keyed = seen.select("page_id", "url", "fetch_time", period(F.col("fetch_time")).alias("period"), F.posexplode(keys_of(F.col("url"))).alias("pos", "key"))
    spans = validity(entries)
    known = seen.agg(F.collect_set(period(F.col("fetch_time"))).alias("periods"))  # one row
    since, until = period(F.col("valid_from")), period(F.col("valid_to"))
    inside = F.explode(F.filter("periods", lambda p: (p >= since) & (until.isNull() | (p <= until))))
    spans = spans.crossJoin(F.broadcast(known)).select("pattern", "action", "valid_from", "valid_to", inside.alias("in_period"))
    active = (F.col("fetch_time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_time") < F.col("valid_to")))
    hits = keyed.join(spans, (F.col("key") == F.col("pattern")) & (F.col("period") == F.col("in_period")) & active)
    best = hits.groupBy("page_id", "url", "fetch_time").agg(F.min(F.struct("pos", "pattern", "action")).alias("hit"))
    best = best.select(F.col("page_id").alias("b_id"), F.col("url").alias("b_url"), F.col("fetch_time").alias("b_time"), "hit")
    same = F.col("page_id").eqNullSafe(F.col("b_id")) & F.col("url").eqNullSafe(F.col("b_url")) & F.col("fetch_time").eqNullSafe(F.col("b_time"))
    return seen.join(best, same, "left").select(
        "page_id", "url", "fetch_time", "n_rows", host_of(F.col("url")).alias("host"), F.col("hit.pattern").alias("matched"), F.col("hit.action").alias("action"),
        (F.coalesce(F.col("hit.action"), F.lit("allow")) != "block").alias("kept"),
    )
