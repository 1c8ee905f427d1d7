"""Structured Streaming versions of the session rules.

* ``answer_or_timeout`` (X1, X2): stream-stream left outer join of questions
  and answers on (session, line) with the 5-minute window as join condition and
  watermarks on both sides; a question with no answer comes out (with null
  answer) once the watermark passes ``asked_at + 5 min`` — the timeout.
* ``first_answer`` (X1, X2, W6): the same with keyed state and an event-time timer, one row per question.
* ``session_guard`` (X4, X5): keyed state per session: starts while running are rejected, the last leaver or a
  cancel ends the run. Events wait in the state and are applied in event-time order.
* ``cancelled_questions`` (X3): one state per session fed by questions, answers, cancels and lines.
* ``line_events`` (X6): ``line_done`` per line and one ``done`` per session, with bounded state;
  ``progress_stream``: running done / total per session (update mode).
* ``cached_results`` (X7): the session cache as keyed state; ``cached_results_batch``: the same inside ``foreachBatch``
  against a table of results.

Each has a batch twin in ``penawar.operators`` used by the tests as reference.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from penawar.config import DEFAULT, MatchConfig
from penawar.functions import text as tx
from penawar.session import ship_package


def answer_or_timeout(questions: DataFrame, choices: DataFrame, cfg: MatchConfig = DEFAULT,
                      lateness: str = "10 minutes") -> DataFrame:
    """Every answer given while its question was pending, and one row with
    ``type`` null per question that timed out. Answers outside the window never
    match (dropped, as the source system drops answers to questions no longer
    pending). The first answer per question is picked downstream (W6)."""
    q = questions.select("session_id", "line_index", "asked_at").withWatermark("asked_at", lateness)
    c = choices.select(F.col("session_id").alias("c_session"), F.col("line_index").alias("c_line"), "type", "id", "url",
                       "at", "event_id").withWatermark("at", lateness)
    cond = ((F.col("session_id") == F.col("c_session")) & (F.col("line_index") == F.col("c_line"))
            & (F.col("at") >= F.col("asked_at"))
            & (F.col("at") < F.col("asked_at") + F.expr(f"INTERVAL {cfg.ask_timeout_minutes} MINUTES")))
    j = q.join(c, cond, "leftOuter")
    return j.select("session_id", "line_index", "asked_at", "type", "id", "url", "at", "event_id",
                    F.when(F.col("type").isNull(), F.lit("input_timeout")).alias("reason"))


FIRST_OUT = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("line_index", T.IntegerType()),
    T.StructField("asked_at", T.TimestampType()), T.StructField("type", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("event_id", T.LongType()),
    T.StructField("reason", T.StringType()),
])
FIRST_STATE = T.StructType([T.StructField("asked", T.TimestampType()), T.StructField("early", T.StringType())])


def first_answer(questions: DataFrame, choices: DataFrame, cfg: MatchConfig = DEFAULT, lateness: str = "10 minutes") -> DataFrame:
    """One row per question: its first answer in event time while it was pending, or the timeout.

    Keyed state per (session, line): the question and its answers so far (answers may arrive before it, late or
    repeated). An event-time timer at the end of the pending window, once the watermark has passed it, picks the
    first answer and frees the state; answers without a question are freed after the same time."""
    ship_package(questions.sparkSession)
    q = questions.select("session_id", "line_index", F.col("asked_at").alias("ts"), F.lit("question").alias("kind"),
                         *[F.lit(None).cast(t).alias(n) for n, t in (("type", "string"), ("id", "string"), ("url", "string"), ("event_id", "long"))])
    c = choices.select("session_id", "line_index", F.col("at").alias("ts"), F.lit("choice").alias("kind"), "type", "id", "url", "event_id")
    minutes = cfg.ask_timeout_minutes

    def run(key, pdfs, state):
        window = pd.Timedelta(minutes=minutes)
        asked, early = (state.get if state.exists else (None, "[]"))
        answers = json.loads(early)
        if state.hasTimedOut:
            state.remove()
            if asked is not None:
                asked = pd.Timestamp(asked)
                live = sorted(a for a in answers if asked <= pd.Timestamp(a[0]) < asked + window)
                at, event_id, kind, ident, url = live[0] if live else (None, None, None, None, None)
                yield pd.DataFrame([(key[0], key[1], asked, kind, ident, url, pd.Timestamp(at) if at else None, event_id,
                                     None if live else "input_timeout")], columns=FIRST_OUT.names)
            return
        last = None
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                if r.kind == "question":
                    asked = r.ts if asked is None else min(pd.Timestamp(asked), r.ts)
                else:
                    answers.append([r.ts.isoformat(), int(r.event_id), r.type, r.id, r.url])
                last = r.ts if last is None else max(last, r.ts)
        if asked is not None:  # only the earliest live answer can win
            start = pd.Timestamp(asked)
            answers = sorted(a for a in answers if start <= pd.Timestamp(a[0]) < start + window)[:1]
        state.update((None if asked is None else pd.Timestamp(asked).to_pydatetime(), json.dumps(answers)))
        due = (pd.Timestamp(asked) if asked is not None else last) + window
        state.setTimeoutTimestamp(max(int(due.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    return (q.unionByName(c).withWatermark("ts", lateness).groupBy("session_id", "line_index")
            .applyInPandasWithState(run, FIRST_OUT, FIRST_STATE, "append", GroupStateTimeout.EventTimeTimeout))


# ---- events of a key in event-time order -------------------------------------------------

# a key's state is forgotten this long (event time) after its last event
EXPIRY_MS = 24 * 3600 * 1000


# and a session whose joins and leaves don't balance this long
IDLE_MS = 30 * 24 * 3600 * 1000


def _ms(ts) -> int:
    """Milliseconds, rounded up: an event counts as passed only when nothing before it can still come."""
    return -(-pd.Timestamp(ts).value // 1_000_000)


def _stamp(text):
    return None if text is None else pd.Timestamp(text)


class Ordered:
    """The state of a key whose events are applied in event-time order, whatever the order of their arrival.

    Events wait in the state until the watermark has passed them (later ones of that time are dropped by Spark, so
    nothing can still come before them). ``rows`` gives the released events as dicts sorted by ``order``; ``keep`` writes the state
    back with a timer at the next waiting event, the next of ``due`` times or the expiry."""

    def __init__(self, state: GroupState, pdfs: Iterator[pd.DataFrame], order: list[str]):
        self.state, self.order = state, order
        held, data = (state.get if state.exists else ("[]", "{}"))
        self.waiting, self.data = json.loads(held), json.loads(data)
        self.now = state.getCurrentWatermarkMs()
        for pdf in ([] if state.hasTimedOut else pdfs):
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                self.waiting.append({k: v.isoformat() if isinstance(v, pd.Timestamp) else v for k, v in r.items()})
        self.last = max([self.data.get("last", 0), *(_ms(r["ts"]) for r in self.waiting)])

    def rows(self) -> list[dict]:
        out = [r for r in self.waiting if _ms(r["ts"]) <= self.now]
        self.waiting = [r for r in self.waiting if _ms(r["ts"]) > self.now]
        return sorted(out, key=lambda r: (pd.Timestamp(r["ts"]), *(r[c] if r[c] is not None else -1 for c in self.order)))

    def keep(self, expiry_ms: int, until_ms: int = 0, due: list[int] | None = None) -> None:
        """``until_ms``: the expiry counts from there at least."""
        end = max(self.last, until_ms) + expiry_ms
        if not self.waiting and not due and self.now > end:
            self.state.remove()
            return
        self.data["last"] = self.last
        self.state.update((json.dumps(self.waiting), json.dumps(self.data)))
        nexts = [_ms(r["ts"]) for r in self.waiting] + list(due or []) or [end]
        self.state.setTimeoutTimestamp(max(min(nexts), self.now + 1))


ORDERED_STATE = T.StructType([T.StructField("waiting", T.StringType()), T.StructField("data", T.StringType())])

GUARD_OUT = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("outcome", T.StringType()),
])


def session_guard(events: DataFrame, expiry_ms: int = EXPIRY_MS, idle_ms: int = IDLE_MS, lateness: str = "1 hour") -> DataFrame:
    """X3-X5 on a stream of session events (session_id, event_id, ts, kind, end_at), kind in start / join / leave / cancel.

    A start while the session runs is rejected; the last leave or a cancel ends the run. Events are applied in the order
    of (ts, event_id), up to ``lateness`` after they happened, so the outcomes don't depend on the order of arrival. Keyed by
    session, spread over tasks by the key's hash.

    A session is forgotten ``expiry_ms`` of event time after its last event and after the end of its accepted run,
    whichever is later; ``idle_ms`` after them while its joins and leaves don't balance (lost leaves, leaves without a join)."""
    ship_package(events.sparkSession)

    def run(key, pdfs, state):
        box = Ordered(state, pdfs, ["event_id"])
        busy, members = _stamp(box.data.get("busy")), box.data.get("members", 0)
        out = []
        for r in box.rows():
            ts, outcome = pd.Timestamp(r["ts"]), "member"
            if r["kind"] == "start":
                ok = busy is None or ts >= busy
                busy = _stamp(r["end_at"]) if ok else busy
                outcome = "accepted" if ok else "rejected"
            elif r["kind"] == "join":
                members += 1
            elif r["kind"] == "leave":
                members -= 1
                outcome = "session_end" if members <= 0 else "left"
            elif r["kind"] == "cancel":
                outcome = "cancelled"
            if outcome in ("session_end", "cancelled"):  # the run is over and the session free
                busy = None
            out.append((key[0], r["event_id"], ts, r["kind"], outcome))
        box.data |= {"busy": busy.isoformat() if busy is not None else None, "members": members}
        box.keep(idle_ms if members else expiry_ms, _ms(busy) if busy is not None else 0)
        if out:
            yield pd.DataFrame(out, columns=GUARD_OUT.names)

    return (events.select("session_id", "event_id", "ts", "kind", "end_at").withWatermark("ts", lateness).groupBy("session_id")
            .applyInPandasWithState(run, GUARD_OUT, ORDERED_STATE, "append", GroupStateTimeout.EventTimeTimeout))


QUESTION_OUT = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("line_index", T.IntegerType()),
    T.StructField("state", T.StringType()), T.StructField("kind", T.StringType()),
])


def cancelled_questions(questions: DataFrame, choices: DataFrame, lines: DataFrame, cfg: MatchConfig = DEFAULT,
                        expiry_ms: int = EXPIRY_MS, lateness: str = "10 minutes") -> DataFrame:
    """X3 on streams: what becomes of every question (answered, cancelled or open, which means timed out) and of every
    line (kept or dropped). Streams: questions (session_id, line_index, asked_at), choices (session_id, line_index, type, at,
    event_id), lines (session_id, line_index, started_at).

    One state per session, fed by the three inputs in event-time order. A cancel closes all pending questions, every
    question raised at or after it and every line started after it; a question leaves the state when it is closed."""
    ship_package(questions.sparkSession)
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    q = questions.select("session_id", F.col("line_index").cast("int"), F.col("asked_at").alias("ts"), F.lit(0).alias("step"), F.lit("question").alias("kind"), none("long", "event_id"))
    n = lines.select("session_id", F.col("line_index").cast("int"), F.col("started_at").alias("ts"), F.lit(0).alias("step"), F.lit("line").alias("kind"), none("long", "event_id"))
    c = choices.select("session_id", F.col("line_index").cast("int"), F.col("at").alias("ts"), F.lit(1).alias("step"),
                       F.when(F.col("type") == "cancel", "cancel").otherwise("answer").alias("kind"), F.col("event_id").cast("long"))
    window = cfg.ask_timeout_minutes * 60_000

    def run(key, pdfs, state):
        box = Ordered(state, pdfs, ["step", "event_id", "line_index"])
        pending, cancelled = box.data.get("pending", {}), _stamp(box.data.get("cancelled"))
        out = []

        def close(line, what):
            pending.pop(line)
            out.append((key[0], int(line), what, "question"))

        for r in box.rows():
            ts, line = pd.Timestamp(r["ts"]), None if r["line_index"] is None else str(int(r["line_index"]))
            for late in [x for x, due in pending.items() if pd.Timestamp(due) <= ts]:
                close(late, "open")
            if r["kind"] == "line":
                out.append((key[0], int(line), "dropped" if cancelled is not None and ts > cancelled else "kept", "line"))
            elif r["kind"] == "question":
                pending[line] = (ts + pd.Timedelta(window, "ms")).isoformat()
                if cancelled is not None:
                    close(line, "cancelled")
            elif r["kind"] == "cancel":
                cancelled = ts if cancelled is None else cancelled
                for x in list(pending):
                    close(x, "cancelled")
            elif line in pending:
                close(line, "answered")
        for late in [x for x, due in pending.items() if _ms(due) <= box.now]:
            close(late, "open")
        box.data |= {"pending": pending, "cancelled": cancelled.isoformat() if cancelled is not None else None}
        box.keep(expiry_ms, due=[_ms(d) for d in pending.values()])
        if out:
            yield pd.DataFrame(out, columns=QUESTION_OUT.names)

    return (q.unionByName(c).unionByName(n).withWatermark("ts", lateness).groupBy("session_id")
            .applyInPandasWithState(run, QUESTION_OUT, ORDERED_STATE, "append", GroupStateTimeout.EventTimeTimeout))


LINE_OUT = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("event", T.StringType()), T.StructField("line_index", T.IntegerType()),
    T.StructField("done", T.LongType()), T.StructField("total", T.LongType()), T.StructField("percent", T.IntegerType()),
])
COUNT_STATE = T.StructType([T.StructField("done", T.LongType()), T.StructField("total", T.LongType()), T.StructField("over", T.BooleanType())])


def line_events(results: DataFrame, sessions: DataFrame, expiry_ms: int = EXPIRY_MS, lateness: str = "1 hour") -> DataFrame:
    """``line_done`` per finished line, and one ``done`` when a session has all its lines. Streams: results (session_id,
    line_index, at), sessions (session_id, total, at). ``done`` and ``percent`` are the session's count so far; total is
    null until the session's row has come.

    A line that is reported again within ``lateness`` counts once (``dropDuplicatesWithinWatermark``, whose state is freed as
    the watermark passes). The count is one row of state per session, freed ``expiry_ms`` after its last event."""
    ship_package(results.sparkSession)
    r = results.select("session_id", F.col("line_index").cast("int").alias("line_index"), F.col("at"), F.lit(None).cast("long").alias("total"))
    s = sessions.select("session_id", F.lit(-1).alias("line_index"), F.col("at"), F.col("total").cast("long").alias("total"))
    once = r.unionByName(s).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["session_id", "line_index"])

    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        done, total, over = (state.get if state.exists else (0, None, False))
        rows = pd.concat(list(pdfs)).sort_values(["line_index"])
        out, last = [], _ms(rows["at"].max())

        def said(event, line):
            out.append((key[0], event, line, done, total, None if not total else int(done * 100 / total + 0.5)))

        for line, n in zip(rows["line_index"], rows["total"]):
            if line < 0:
                total = int(n)
            else:
                done += 1
                said("line_done", int(line))
        if total is not None and done >= total and not over:
            over = True
            said("done", None)
        state.update((done, total, over))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + expiry_ms)
        if out:
            frame = pd.DataFrame(out, columns=LINE_OUT.names)
            yield frame.astype({"line_index": "Int32", "done": "Int64", "total": "Int64", "percent": "Int32"})

    return once.groupBy("session_id").applyInPandasWithState(run, LINE_OUT, COUNT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


CACHE_OUT = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("line_index", T.IntegerType()), T.StructField("raw_text", T.StringType()),
    T.StructField("cache_key", T.StringType()), T.StructField("source", T.StringType()), T.StructField("product_id", T.StringType()),
    T.StructField("price", T.DoubleType()), T.StructField("cached", T.BooleanType()),
])


def cached_results(lines: DataFrame, results: DataFrame, expiry_ms: int = EXPIRY_MS, lateness: str = "1 hour") -> DataFrame:
    """The session cache as keyed state. Streams: lines (session_id, line_index, raw_text, at), results (session_id,
    line_index, raw_text, source, product_id, price, at).

    Keyed by (session, normalised text): the first line comes out at once with ``cached`` false, to be matched; lines that
    repeat it wait in the state and come out with its result, ``cached`` true, as soon as that is there. After an error or a
    cancelled result the next waiting line comes out to be matched. Results are read once; a key is freed
    ``expiry_ms`` of event time after its last event, and lines still waiting then come out to be matched."""
    ship_package(lines.sparkSession)
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    given = ["session_id", F.col("line_index").cast("int").alias("line_index"), "raw_text", tx.normalise_key("raw_text").alias("cache_key"), "at"]
    a = lines.select(*given, none("string", "source"), none("string", "product_id"), none("double", "price"))
    b = results.select(*given, "source", "product_id", F.col("price").cast("double").alias("price"))

    def run(key, pdfs, state):
        held = json.loads(state.get[0]) if state.exists else {"asked": None, "waiting": [], "result": None}
        out = []

        def ask():
            line, raw = held["waiting"].pop(0)
            held["asked"] = line
            out.append((key[0], line, raw, key[1], None, None, None, False))

        if state.hasTimedOut:
            while held["waiting"]:
                ask()
            state.remove()
        else:
            rows = pd.concat(list(pdfs)).sort_values(["line_index"], kind="mergesort")
            for r in rows[rows["source"].isna()].itertuples(index=False):
                held["waiting"].append((int(r.line_index), r.raw_text))
            failed = False
            for r in rows[rows["source"].notna()].itertuples(index=False):
                if r.source in ("error", "cancelled"):
                    failed = True
                elif held["result"] is None:
                    held["result"] = (r.source, r.product_id, None if pd.isna(r.price) else float(r.price))
            if held["result"] is not None:
                out += [(key[0], line, raw, key[1], *held["result"], True) for line, raw in held["waiting"]]
                held["waiting"] = []
            elif held["waiting"] and (held["asked"] is None or failed):
                ask()
            elif failed:
                held["asked"] = None
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(_ms(rows["at"].max()), state.getCurrentWatermarkMs()) + expiry_ms)
        if out:
            yield pd.DataFrame(out, columns=CACHE_OUT.names)

    return (a.unionByName(b).withWatermark("at", lateness).groupBy("session_id", "cache_key")
            .applyInPandasWithState(run, CACHE_OUT, T.StructType([T.StructField("held", T.StringType())]), "append", GroupStateTimeout.EventTimeTimeout))


def progress_stream(results: DataFrame, totals: DataFrame) -> DataFrame:
    """Done lines per session as results arrive (stream-static join with the
    line totals; output mode ``update``)."""
    # a line that is reported again counts once, as in the batch twin
    done = results.dropDuplicates(["session_id", "line_index"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("done"))
    return done.join(totals, "session_id").select(
        "session_id", "done", "total", F.round(F.col("done") * 100.0 / F.col("total")).cast("int").alias("percent"))


def cached_results_batch(batch: DataFrame, results_so_far: DataFrame) -> DataFrame:
    """X7 inside ``foreachBatch``: lines of the micro-batch whose normalised text
    already has a (non error, non cancelled) result in the same session take it,
    marked ``cached``; the rest are returned with ``cached`` false for matching. Of lines that repeat a text within the
    batch only the first (``donor_index``) is matched; the others are ``cached`` and take its result once it is there."""
    keyed = batch.withColumn("cache_key", tx.normalise_key("raw_text"))
    donors = keyed.groupBy("session_id", "cache_key").agg(F.min("line_index").alias("donor_index"))
    keyed = keyed.join(donors, ["session_id", "cache_key"])
    done = (results_so_far.where(~F.col("source").isin("error", "cancelled"))
            .withColumn("cache_key", tx.normalise_key("raw_text"))
            .groupBy("session_id", "cache_key")
            .agg(F.min_by(F.struct("source", "product_id", "price"), F.col("line_index")).alias("r")))
    j = keyed.join(done, ["session_id", "cache_key"], "left")
    return j.select("session_id", "line_index", "raw_text", "cache_key", F.col("r.source").alias("source"),
                    F.col("r.product_id").alias("product_id"), F.col("r.price").alias("price"),
                    (F.col("r").isNotNull() | (F.col("line_index") > F.col("donor_index"))).alias("cached"),
                    F.when(F.col("r").isNull(), F.col("donor_index")).alias("donor_index"))
