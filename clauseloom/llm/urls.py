"""URL filters with a temporal list join.

List entries are dated: an entry is added to a list on one day and removed on a later one, perhaps several times. The dated
events of an entry become validity intervals, and every capture is judged by the entries that were active when it
was fetched: an equi-join on the capture's keys (its host and the domains above it, its host with each path
prefix) with the interval as a further condition.

Equal captures (same URL, same day) are judged once, so that neither a page fetched over and over nor its host's keys
weigh on the join by their number; a host with a third of all URLs is one join key against the few intervals of its entries,
which the planner broadcasts when their size allows or splits as a skewed partition otherwise.

Defined results: a URL that is null, or has no scheme or no host, has no keys and is allowed; user, port and a closing dot are no part of a host; a null day meets no interval; events of
the same entry and day count in the order add, remove; an entry added twice in a row stays active; a removal without an
addition does nothing; repeated captures each keep their row; columns
``lists`` and ``verdict`` of the captures are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauseloom.llm.common import named

#: Lists whose entries override all others.
ALLOW = ("allow",)


#: Of what stands between the slashes: a user and password, a port, the root's dot.
NOT_HOST = (r"^.*@", r":[0-9]*$", r"[.]+$")


def host(url: Column) -> Column:
    """The host in lower case, without user, port and closing dot."""
    name = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    return F.lower(reduce(lambda n, part: F.regexp_replace(n, part, ""), NOT_HOST, name))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def keys(url: Column) -> Column:
    """What an entry can name: ``domain`` (the host and all domains above it that have a dot), ``prefix`` (the host
    with each path prefix that ends at a slash or at the path's end)."""
    labels, parts = F.split(host(url), r"\."), F.split(path(url), "/")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda at: F.array_join(F.slice(labels, at, F.size(labels)), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(host(url), F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )
    named_keys = F.concat(
        F.transform(domains, lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("pattern"))),
        F.transform(prefixes, lambda p: F.struct(F.lit("prefix").alias("kind"), p.alias("pattern"))),
    )
    return F.when(host(url) != "", F.array_distinct(named_keys)).otherwise(F.slice(named_keys, 1, 0))


def intervals(events: DataFrame) -> DataFrame:
    """``events(list, kind, pattern, action, day)`` → ``(list, kind, pattern, since, until)``: days on which entries are
    active, ``until`` not included and null for entries that still are."""
    order = W.partitionBy("list", "kind", "pattern").orderBy("day", "action")
    until = F.lead("day").over(order)
    steps = events.filter("day is not null").select("list", "kind", "pattern", "action", F.col("day").alias("since"), until.alias("until"))
    return steps.filter("action = 'add' and (until is null or until > since)").drop("action")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` with ``lists`` (names of the lists active for a capture, sorted) and ``verdict``: ``allow`` where an
    allow list or no list is, ``block`` otherwise."""
    distinct = captures.select(named(url).alias("url_"), named(day).alias("day_")).distinct()
    # A capture becomes many rows: without a key, the exchange is not coalesced into a few tasks.
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = distinct.repartition(parts).withColumn("key", F.explode(keys(F.col("url_")))).select("url_", "day_", "key.kind", "key.pattern")
    active = (F.col("day_") >= F.col("since")) & (F.col("until").isNull() | (F.col("day_") < F.col("until")))
    hits = asked.join(entries, ["kind", "pattern"]).filter(active).groupBy("url_", "day_").agg(
        F.array_sort(F.collect_set("list")).alias("lists")
    )
    met = (named(url) == hits["url_"]) & (named(day) == hits["day_"])
    lists = F.coalesce(hits["lists"], F.array().cast("array<string>"))
    blocked = (F.size(lists) > 0) & ~F.arrays_overlap(lists, F.array(*map(F.lit, ALLOW)))
    own = [captures[f"`{c}`"] for c in captures.columns if c not in ("lists", "verdict")]
    return captures.join(hits, met, "left").select(
        *own, lists.alias("lists"), F.when(blocked, "block").otherwise("allow").alias("verdict")
    )
