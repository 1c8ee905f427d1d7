"""Session rules over event tables (A9, W8, X4, X5) — batch twins of ``penawar.streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penawar.operators.chunks import running
from penawar.session import cut_lineage


def session_members(members: DataFrame) -> DataFrame:
    """Active participants per session = joins minus leaves (an aggregate,
    combined map-side, so a crowded session is no hot spot)."""
    return members.groupBy("session_id").agg(F.sum("delta").alias("members"),
                                              F.count(F.lit(1)).alias("events"))


BUCKET_SECONDS = 3600


def running_sum(df: DataFrame, key: str, order: list[str], value: str, name: str, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """Running sum of ``value`` per ``key`` in ``order`` (first column: a time or a number): see ``operators.chunks``.
    A time is cut into buckets of ``bucket`` seconds, a number into runs of ``bucket``."""
    first = F.col(order[0])
    if df.schema[order[0]].dataType.typeName().startswith("timestamp"):
        first = F.unix_timestamp(first.cast("timestamp"))
    return running(df, [key], F.floor(first / bucket), order, F.col(value), name)


def last_leaver(members: DataFrame) -> DataFrame:
    """The session ends at the first leave that takes the running count
    of participants to zero or below."""
    r = running_sum(members, "session_id", ["ts", "event_id"], "delta", "running")
    drops = r.where((F.col("delta") < 0) & (F.col("running") <= 0))
    return drops.groupBy("session_id").agg(
        F.min_by(F.struct("ts", "event_id"), F.struct("ts", "event_id")).alias("e")).select(
        "session_id", F.col("e.ts").alias("ended_at"), F.col("e.event_id").alias("event_id"))


def next_at_or_after(asks: DataFrame, events: DataFrame, key: str, ask_at: str, event_at: str, event_id: str, bucket: int) -> DataFrame:
    """``asks`` plus ``next_id``: per key the first event (by time, id) at or after ``ask_at``.

    An as-of search in time buckets: the first event of the ask's own bucket by a window over (key, bucket), else the
    first event of the next bucket that has one, by a window over the buckets of the key. No task holds a whole key."""
    cut = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bucket)
    a = asks.withColumn("_t", F.col(ask_at)).withColumn("_event", F.lit(None).cast("long"))
    e = events.select(F.col(key), F.col(event_at).alias("_t"), F.col(event_id).cast("long").alias("_event"))
    both = a.unionByName(e, allowMissingColumns=True).withColumn("_bucket", cut("_t"))
    # backwards in time, so that the frame grows row by row
    own = (Window.partitionBy(key, "_bucket").orderBy(F.desc("_t"), F.col("_event").desc_nulls_last())
           .rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_own", F.last("_event", ignorenulls=True).over(own))
    heads = (e.withColumn("_bucket", cut("_t")).groupBy(key, "_bucket")
             .agg(F.min_by("_event", F.struct("_t", "_event")).alias("_head")))
    buckets = both.select(key, "_bucket").distinct().join(heads, [key, "_bucket"], "left")
    later = Window.partitionBy(key).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(key, "_bucket", F.last("_head", ignorenulls=True).over(later).alias("_later"))
    return (both.where(F.col("_event").isNull()).join(buckets, [key, "_bucket"])
            .select(*asks.columns, F.coalesce("_own", "_later").alias("next_id")))


def duplicate_start(starts: DataFrame, ends: DataFrame | None = None, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """A start while the session is still running is rejected. ``ends`` (session_id, at): cancels and last leaves,
    which end the run at once.

    After an accepted start the next accepted one is the first start at or after its end, so the accepted starts are a
    chain of links from the session's first start. The links come from an as-of search, and pointer jumping follows
    them in log2(chain) rounds: no task holds a whole session. Ids must be unique in a session."""
    s = starts.select("session_id", "start_id", "start_at", "end_at").where(F.col("session_id").isNotNull())
    if ends is not None:
        e = ends.select("session_id", "at").distinct().withColumn("_id", F.xxhash64("session_id", "at"))
        cut = next_at_or_after(s.select("session_id", "start_id", "start_at"), e, "session_id", "start_at", "at", "_id", bucket)
        cut = cut.join(e.withColumnRenamed("_id", "next_id"), ["session_id", "next_id"]).select("session_id", "start_id", "at")
        s = s.join(cut, ["session_id", "start_id"], "left").withColumn("end_at", F.least("end_at", "at")).drop("at")
    # a run of no length ends before the next start in order, even at the same time
    after = Window.partitionBy("session_id", "start_at").orderBy("start_id")
    s = s.withColumn("_twin", F.lead("start_id").over(after))
    s = s.withColumn("_empty", F.col("end_at") <= F.col("start_at"))
    s = s.withColumn("_ask", F.when(F.col("_empty"), F.col("start_at") + F.expr("INTERVAL 1 MICROSECOND")).otherwise(F.col("end_at")))
    s = next_at_or_after(s, s.select("session_id", "start_at", "start_id"), "session_id", "_ask", "start_at", "start_id", bucket)
    s = cut_lineage(s.withColumn("next", F.when(F.col("_empty"), F.coalesce("_twin", "next_id")).otherwise(F.col("next_id")))
                    .select("session_id", "start_id", "start_at", "next"))
    accepted = s.groupBy("session_id").agg(F.min_by("start_id", F.struct("start_at", "start_id")).alias("start_id"))
    jumps = s.where(F.col("next").isNotNull()).select("session_id", "start_id", "next")
    known = 0
    while True:
        step = accepted.join(jumps, ["session_id", "start_id"]).select("session_id", F.col("next").alias("start_id"))
        accepted = cut_lineage(accepted.unionByName(step).distinct())
        n = accepted.count()
        if n == known:
            break
        known = n
        far = jumps.select("session_id", F.col("start_id").alias("next"), F.col("next").alias("_far"))
        jumps = cut_lineage(jumps.join(far, ["session_id", "next"]).select("session_id", "start_id", F.col("_far").alias("next")))
    ok = accepted.withColumn("accepted", F.lit(True))
    return (s.select("session_id", "start_id").join(ok, ["session_id", "start_id"], "left")
            .withColumn("accepted", F.coalesce("accepted", F.lit(False))))


# Fixed value: the message of a request without a session or lines.
MSG_BAD_REQUEST = "sessionId and lines[] are required"


def validate_requests(requests: DataFrame) -> DataFrame:
    """A start request needs a session id and a list of lines (``has_lines``; an empty list counts)."""
    bad = F.coalesce(F.col("session_id"), F.lit("")) == ""
    return requests.withColumn("error", F.when(bad | ~F.col("has_lines"), F.lit(MSG_BAD_REQUEST)))
