"""URL filters as a temporal join of captures with dated list entries.

A list log holds entries (list, pattern, action, time). Per list and pattern
the entries become validity intervals: an add opens one, the next remove ends
it, an add while open changes nothing, and of entries at one moment an add
wins. A capture is judged by the intervals that hold at its fetch time: start
included, end excluded.

A pattern is a domain, which covers its subdomains, or a domain and the first
parts of a path, ended by a slash. A capture asks for every domain and path
start of its url by equality, as deep as the deepest pattern of the log, and time is cut into buckets that join the key,
so neither a busy host nor a pattern with a long history multiplies the other:
a bucket that is asked for meets the intervals that start in it and the one
that reaches into it, so a list costs its entries and the questions, not its years.
Hosts in brackets are one label; a final dot of a host is not part of it; names
in punycode match patterns in punycode only.

Defined results: captures without url or time match nothing; entries without
list, pattern, time or with another action are ignored; repeated captures are
judged once and each get the result; empty tables give no matches. Extra
columns of captures are carried, columns called like the new ones replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_DAYS = 1
ADDED = ("n_block", "n_allow", "since", "verdict")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:@]*)", 1)
    return F.lower(F.regexp_replace(found, r"\.$", ""))


def patterns_of(url: Column, slashes: int | None = None) -> Column:
    """All patterns that cover a url: its domain, parent domains, and path starts of the full domain.

    ``slashes`` leaves out path starts with more slashes than any pattern in use has.
    """
    host = host_of(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    labels = F.when(F.startswith(host, F.lit("[")), F.array(host)).otherwise(F.split(host, r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pieces = F.split(path, "/")
    most = F.size(pieces) - 1
    parts = F.slice(pieces, F.lit(1), most if slashes is None else F.least(most, F.lit(slashes)))
    starts = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
    )
    return F.when(host != "", F.array_distinct(F.concat(domains, starts))).otherwise(F.array().cast("array<string>"))


def _bucket(time: Column | str, days: int) -> Column:
    return F.floor(F.unix_seconds(F.col(time) if isinstance(time, str) else time) / (86400 * days)).cast("int")


def validity(log: DataFrame, days: int = BUCKET_DAYS) -> DataFrame:
    """(list, pattern, valid_from, valid_to): disjoint intervals, the last without end where it is open.

    Windows run over one pattern in one bucket of time; what crosses buckets is carried by one row per bucket.
    """
    key, moment = ["list", "pattern"], ["list", "pattern", "bucket"]
    clean = log.where(F.col("action").isin("add", "remove") & F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("ts").isNotNull())
    entries = clean.groupBy(*key, "ts").agg(F.max(F.col("action") == "add").alias("on")).withColumn("bucket", _bucket("ts", days))
    last = entries.groupBy(*moment).agg(F.max_by("on", "ts").alias("last"))
    before = F.lag("last").over(Window.partitionBy(*key).orderBy("bucket"))
    carried = last.select(*moment, F.coalesce(before, F.lit(False)).alias("carried"))
    inside = Window.partitionBy(*moment).orderBy("ts")
    was = F.coalesce(F.lag("on").over(inside), F.col("carried"))
    changes = entries.join(carried, moment).withColumn("was", was).where(F.col("on") != F.col("was")).drop("was", "carried")
    opening = changes.groupBy(*moment).agg(F.min("ts").alias("first"))
    following = opening.select(*moment, F.lead("first").over(Window.partitionBy(*key).orderBy("bucket")).alias("following"))
    until = F.coalesce(F.lead("ts").over(inside), F.col("following"))
    return changes.join(following, moment).withColumn("valid_to", until).where("on").select(*key, F.col("ts").alias("valid_from"), "valid_to")


def active(spans: DataFrame, wanted: DataFrame, days: int = BUCKET_DAYS) -> DataFrame:
    """(list, pattern, bucket, valid_from, valid_to): the intervals that may hold in the wanted (pattern, bucket) pairs.

    They start in that bucket, or are the one that reaches into it: intervals of one list and pattern are disjoint, so
    it is the last to start in an earlier bucket. A long interval becomes a row of the buckets asked for, not of all
    buckets it spans, and a window over one pattern holds one row per bucket with a start or a question.
    """
    key = ["list", "pattern"]
    starts = spans.withColumn("bucket", _bucket("valid_from", days))
    last = starts.groupBy(*key, "bucket").agg(F.max("valid_from").alias("valid_from"), F.max_by("valid_to", "valid_from").alias("valid_to"))
    known = last.select(*key).distinct()
    asked = wanted.join(known, "pattern").select(*key, "bucket", F.lit(True).alias("asked"))
    line = last.withColumn("asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    merged = line.groupBy(*key, "bucket").agg(F.max("asked").alias("asked"), F.max("valid_from").alias("start"), F.max("valid_to").alias("stop"))
    # The end of the last start alone: an open interval must not take the end of an older one.
    latest = F.last(F.when(F.col("start").isNotNull(), F.struct("start", "stop")), ignorenulls=True)
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reaching = merged.withColumn("held", latest.over(earlier)).where("asked AND held IS NOT NULL")
    reaching = reaching.select(*key, "bucket", F.col("held.start").alias("valid_from"), F.col("held.stop").alias("valid_to"))
    reaching = reaching.where(F.col("valid_to").isNull() | (_bucket("valid_to", days) >= F.col("bucket")))
    return starts.select(*key, "bucket", "valid_from", "valid_to").join(wanted, ["pattern", "bucket"], "left_semi").unionByName(reaching)


def judge(captures: DataFrame, log: DataFrame, url: str = "url", fetched: str = "fetched", days: int = BUCKET_DAYS) -> DataFrame:
    """The captures with n_block and n_allow (active patterns of the lists ``block`` and ``allow`` that cover them),
    since (start of the oldest of them) and verdict: allowed if any allows, else blocked if any blocks, else open.
    """
    asked = captures.where(F.col(url).isNotNull() & F.col(fetched).isNotNull()).select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).distinct()
    slashes = log.agg(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/")))).alias("n")).first()["n"] or 0  # one row
    asked = asked.withColumn("pattern", F.explode(patterns_of(F.col("_url"), slashes))).withColumn("bucket", _bucket("_at", days))
    laid = active(validity(log, days), asked.select("pattern", "bucket").distinct(), days)
    holds = (F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    met = asked.join(laid, ["pattern", "bucket"]).where(holds)
    found = met.groupBy("_url", "_at").agg(
        F.count_if(F.col("list") == "block").alias("n_block"), F.count_if(F.col("list") == "allow").alias("n_allow"), F.min("valid_from").alias("since")
    )
    kept = [c for c in captures.columns if c not in ADDED]
    out = captures.select(*kept).join(found, (captures[url] == found["_url"]) & (captures[fetched] == found["_at"]), "left")
    block, allow = F.coalesce("n_block", F.lit(0)), F.coalesce("n_allow", F.lit(0))
    verdict = F.when(allow > 0, "allowed").when(block > 0, "blocked").otherwise("open")
    return out.select(*kept, block.cast("long").alias("n_block"), allow.cast("long").alias("n_allow"), "since", verdict.alias("verdict"))
