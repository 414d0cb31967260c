"""URL filters whose list entries are dated: an as-of join of captures against the entries active at fetch time.

An entry says that a pattern is blocked, allowed or withdrawn from a date on. The dated entries of a pattern become validity intervals, each ending
where the next begins. A pattern is a host with all its subdomains, or such a host with the first segment of a path. Each capture is held
against the patterns that cover its URL with an equality join plus the interval; the most specific active entry decides.

Of entries with one pattern and date, ``block`` stands before ``allow`` before ``withdraw``. Entries without pattern, action or date, and actions
of other names, are left out. A capture without a usable URL or time is ``unlisted``. Repeated captures are judged alike; empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import BROADCAST_KEYS

ACTIONS = ("block", "allow", "withdraw")  # in the order in which they win on one day


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and final dot; null when there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def first_segment(url: Column) -> Column:
    """The first segment of the path with its slash; empty when there is none."""
    return F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*)://[^/?#]*(/[^/?#]+)", 1)


def covering_patterns(url: Column) -> Column:
    """All patterns that could cover a URL: its host and parent domains of two and more labels, each also with the first path segment."""
    labels = F.split(host_of(url), r"\.")
    counts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    hosts = F.transform(counts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = first_segment(url)
    with_path = F.when(segment == "", F.array().cast("array<string>")).otherwise(F.transform(hosts, lambda h: F.concat(h, segment)))
    return F.when(host_of(url).isNotNull(), F.array_distinct(F.concat(hosts, with_path)))


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, action, since, until`` from dated ``pattern, action, dated``; ``until`` is null for the last."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    sound = entries.filter(F.col("pattern").isNotNull() & F.col("dated").isNotNull() & F.col("action").isin(*ACTIONS))
    daily = sound.groupBy("pattern", "dated").agg(F.min_by("action", rank).alias("action"))
    following = F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated"))
    return daily.select("pattern", "action", F.col("dated").alias("since"), following.alias("until"))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``key, verdict, pattern, since`` per capture: ``blocked`` or ``allowed`` by the most specific active entry, else ``unlisted``."""
    active = intervals(entries).filter(F.col("action") != "withdraw")
    small = active.limit(BROADCAST_KEYS // 4 + 1).count() <= BROADCAST_KEYS // 4
    asked = captures.select(F.struct(F.col(key).alias("id"), F.col(url).alias("url"), F.col(fetched).alias("at")).alias("_c"))
    patterns = asked.select("_c", F.explode(covering_patterns(F.col("_c.url"))).alias("_p"))
    here = (F.col("_p") == F.col("pattern")) & (F.col("_c.at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_c.at") < F.col("until")))
    met = patterns.join(F.broadcast(active) if small else active, here)
    # A path is more specific than its host, a longer host than its parents.
    strength = F.struct(F.size(F.split(F.split("pattern", "/")[0], r"\.")).alias("labels"), F.contains("pattern", F.lit("/")).alias("path"), "pattern", "since", "action")
    # Captures that repeat are judged once per distinct (id, url, time), and combined before the shuffle.
    decided = met.groupBy("_c").agg(F.max(strength).alias("_d"))
    judged = asked.select(F.col("_c")).join(decided.select(F.col("_c").alias("_o"), "_d"), F.col("_c").eqNullSafe(F.col("_o")), "left")
    verdict = F.when(F.col("_d.action") == "block", "blocked").when(F.col("_d.action") == "allow", "allowed").otherwise("unlisted")
    return judged.select(F.col("_c.id").alias(key), verdict.alias("verdict"), F.col("_d.pattern").alias("pattern"), F.col("_d.since").alias("since"))
