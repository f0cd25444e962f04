"""URL filters by temporal list join: which list entries were active when a page was fetched.

Dated entries (block, allow, remove) of a key become validity intervals: an entry holds from its day to the day before the
key's next entry. A capture looks up its path prefix, host and domain by an equality join on the key and the interval
that holds its fetch day; the most specific active entry decides. Hot hosts are a skewed left side, which adaptive
execution splits; a key has one row per dated entry, so nothing multiplies: at most one interval of a key holds a day.

Of entries of one key and day the last action by name counts. A null URL, or one without a host, matches nothing; a null
day matches nothing. Repeated rows are evaluated one by one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dueward.llm.common import stored

# Kinds of keys, from the least to the most specific.
KINDS = ("domain", "host", "path")
_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(/[^/?#]*)?"


def keys(url: Column) -> dict[str, Column]:
    """Domain (the last three labels), host without ``www.``, and host with the first path segment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.", "")
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    return {"domain": domain, "host": host, "path": F.concat(host, F.regexp_extract(url, _URL, 2))}


def validity(entries: DataFrame) -> DataFrame:
    """``(kind, key, day, action)`` to ``(kind, key, action, first_day, next_day)``."""
    dated = entries.where("key <> '' AND day IS NOT NULL").groupBy("kind", "key", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(W.partitionBy("kind", "key").orderBy("day"))
    return dated.select("kind", "key", "action", F.col("day").alias("first_day"), following.alias("next_day")).where("action <> 'remove'")


def evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``(capture, url, day)`` to each capture's active entries and the decision of the most specific one."""
    rows = stored(captures.select("capture", "url", "day", F.monotonically_increasing_id().alias("row")))
    own = keys(F.col("url"))
    ranked = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(kind).alias("kind"), own[kind].alias("key")) for k, kind in enumerate(KINDS)))
    asked = rows.where("url IS NOT NULL").select("row", F.col("day").alias("at"), F.inline(ranked)).where("key <> ''")
    holds = (F.col("first_day") <= F.col("at")) & (F.col("next_day").isNull() | (F.col("at") < F.col("next_day")))
    active = asked.join(validity(entries), ["kind", "key"]).where(holds)
    decided = active.groupBy("row").agg(
        F.count("*").alias("n_active"), F.max(F.struct("rank", "action", "kind", "key")).alias("by"))
    return rows.join(decided, "row", "left").select(
        "capture", "url", "day", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.coalesce(F.col("by.action") == "block", F.lit(False)).alias("blocked"), F.col("by.kind").alias("rule_kind"), F.col("by.key").alias("rule_key"))


def _number(text: Column) -> Column:
    """A number from 0 to 65535 that depends on the text alone."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def derived_entries(captures: DataFrame) -> DataFrame:
    """A dated list for tables that come without one: three entries for every key that occurs, by a hash of the key."""
    own = keys(F.col("url"))
    every = captures.where("url IS NOT NULL").select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), own[k].alias("key")) for k in KINDS))))
    v = _number(F.concat_ws(":", "kind", "key"))
    first = v % 300
    dated = F.array(
        F.struct(first.alias("day"), F.when(v % 3 == 0, "block").otherwise("allow").alias("action")),
        F.struct((first + 20 + v % 50).alias("day"), F.lit("remove").alias("action")),
        F.struct((first + 90 + v % 70).alias("day"), F.when(v % 5 == 0, "block").otherwise("allow").alias("action")))
    return every.distinct().where("key <> ''").select("kind", "key", F.inline(dated))
