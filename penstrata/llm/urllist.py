"""URL filters: a temporal join of captures with a dated list.

Entries are hosts, each with dated events, ``add`` or ``remove``. Events
become validity intervals: an entry is active from an ``add`` until the next
event. A capture is blocked if an entry that is its host or a parent domain
of it was active when it was fetched. Intervals are cut at the bounds of time
bins, so that the as-of join is an equality on (host, bin) with a range
behind it: neither a long history of one host nor a host with most captures
multiplies, and the join's larger side can be split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a time bin.
BIN_DAYS = 128
#: Fixed value: the host of an absolute URL, without user and port.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """The lower-case host without a final dot; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def intervals(events: DataFrame) -> DataFrame:
    """(entry, valid_from, valid_to) of ``events(entry, at, action)``; valid_to is null while the entry stays active.

    Events without an entry or a date, or with another action, take no part.
    Of events of one entry at one time ``remove`` counts. A second ``add``
    starts a new interval, which changes nothing but the date that is told.
    """
    known = events.select(F.regexp_replace(F.lower("entry"), r"^\.+|\.+$", "").alias("entry"), F.col("at").cast("timestamp").alias("at"), F.lower("action").alias("action"))
    known = known.where("entry is not null and entry <> '' and at is not null and action in ('add', 'remove')")
    one = known.groupBy("entry", "at").agg(F.max("action").alias("action"))
    after = F.lead("at").over(Window.partitionBy("entry").orderBy("at"))
    return one.withColumn("valid_to", after).where("action = 'add'").select("entry", F.col("at").alias("valid_from"), "valid_to")


def _bin(at: Column) -> Column:
    return F.floor(F.unix_date(at.cast("date")) / BIN_DAYS).cast("int")


def judged(captures: DataFrame, events: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, blocked, entry, listed_at) of every capture.

    ``captures(page_id, url, fetched_at)``; ``entry`` is the longest active
    one and ``listed_at`` the start of its interval. A null, empty or relative
    URL and a null time match nothing. Repeated rows each come back; an empty
    table gives none, an empty list blocks nothing. Other columns are not read.

    Parent domains are looked up for distinct hosts, so that a host with most
    captures is one row there, and a domain above most hosts goes unless the
    list names it. Captures then meet only what is listed for their own host
    and bin, by an equality whose larger side can be split.
    """
    rows = captures.select(F.monotonically_increasing_id().alias("k"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("bin", _bin(F.col("fetched_at")))
    span = rows.agg(F.min("fetched_at").alias("low"), F.max("fetched_at").alias("high"))  # one row
    live = intervals(events).crossJoin(F.broadcast(span)).where("valid_from <= high and (valid_to is null or valid_to > low)")
    first, last = _bin(F.greatest("valid_from", "low")), _bin(F.least(F.coalesce("valid_to", "high"), "high"))
    cut = live.select("entry", "valid_from", "valid_to", F.explode(F.sequence(first, last)).alias("bin"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = rows.where("host is not null").select("host").distinct().select("host", F.explode(above).alias("entry")).join(cut, "entry")
    within = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    found = rows.alias("c").join(listed.alias("e"), (F.col("c.host") == F.col("e.host")) & (F.col("c.bin") == F.col("e.bin")) & within, "left")
    best = F.max(F.when(F.col("entry").isNotNull(), F.struct(F.length("entry").alias("n"), "entry", "valid_from"))).alias("best")
    out = found.groupBy("k", "page_id", "url", "fetched_at").agg(best)
    return out.select("page_id", "url", "fetched_at", F.col("best").isNotNull().alias("blocked"), F.col("best.entry").alias("entry"), F.col("best.valid_from").alias("listed_at"))
