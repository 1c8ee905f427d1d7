"""Streaming operators against their batch twins (file source, availableNow, memory sink)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from penawar.operators import sessions as ses_ops
from penawar.streaming import stream


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True) \
        .option("checkpointLocation", tempfile.mkdtemp(prefix="ckpt-")).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_answer_or_timeout_stream(spark):
    d = tempfile.mkdtemp(prefix="stream-")
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    qs = spark.createDataFrame([("s", 0, t0), ("s", 1, t0 + dt.timedelta(minutes=1)),
                                ("s", 2, t0 + dt.timedelta(hours=3))],  # closing event moves the watermark
                               "session_id string, line_index int, asked_at timestamp")
    cs = spark.createDataFrame([("s", 0, "product", "7", None, t0 + dt.timedelta(minutes=3), 1),
                                ("s", 1, "product", "7", None, t0 + dt.timedelta(minutes=9), 2),
                                ("s", 2, "skip", None, None, t0 + dt.timedelta(hours=3, minutes=1), 3)],
                               "session_id string, line_index int, type string, id string, url string, at timestamp, event_id long")
    qs.write.parquet(os.path.join(d, "q"))
    cs.write.parquet(os.path.join(d, "c"))
    qstream = spark.readStream.schema(qs.schema).parquet(os.path.join(d, "q"))
    cstream = spark.readStream.schema(cs.schema).parquet(os.path.join(d, "c"))
    out = _run(spark, stream.answer_or_timeout(qstream, cstream), "answers_t1")
    got = {(r.line_index, r.type, r.reason) for r in out.collect()}
    assert (0, "product", None) in got and (2, "skip", None) in got
    # line 1 was answered after 8 minutes: outside the window -> timeout row once the watermark passed
    assert (1, None, "input_timeout") in got


def test_session_guard_matches_batch_twin(spark):
    d = tempfile.mkdtemp(prefix="guard-")
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    m = dt.timedelta(minutes=1)
    rows = [("a", 1, t0, "start", t0 + 10 * m), ("a", 2, t0 + 5 * m, "start", t0 + 15 * m),
            ("a", 3, t0 + 11 * m, "start", t0 + 20 * m), ("b", 4, t0, "start", t0 + m),
            ("a", 5, t0 + 12 * m, "join", None), ("a", 6, t0 + 13 * m, "leave", None),
            ("z", 99, t0 + 600 * m, "join", None)]  # moves the watermark past the others
    ev = spark.createDataFrame(rows, "session_id string, event_id long, ts timestamp, kind string, end_at timestamp")
    ev.write.parquet(d + "/e")
    out = _run(spark, stream.session_guard(spark.readStream.schema(ev.schema).parquet(d + "/e")), "guard_t1")
    got = {r.event_id: r.outcome for r in out.collect()}
    starts = ev.where(F.col("kind") == "start").select("session_id", F.col("event_id").alias("start_id"),
                                                        F.col("ts").alias("start_at"), "end_at")
    twin = {r.start_id: ("accepted" if r.accepted else "rejected") for r in ses_ops.duplicate_start(starts).collect()}
    assert {k: got[k] for k in twin} == twin == {1: "accepted", 2: "rejected", 3: "accepted", 4: "accepted"}
    assert got[6] == "session_end"


def test_progress_stream(spark):
    d = tempfile.mkdtemp(prefix="prog-")
    res = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0)], "session_id string, line_index int")
    res.write.parquet(d + "/r")
    totals = spark.createDataFrame([("s", 4), ("t", 1)], "session_id string, total long")
    out = _run(spark, stream.progress_stream(spark.readStream.schema(res.schema).parquet(d + "/r"), totals),
               "progress_t1", mode="update")
    got = {r.session_id: (r.done, r.total, r.percent) for r in out.collect()}
    assert got == {"s": (2, 4, 50), "t": (1, 1, 100)}


def test_cached_results_in_foreach_batch(spark):
    d = tempfile.mkdtemp(prefix="cache-")
    done = spark.createDataFrame([("s", 0, " Meja Kantor ", "auto_database", "7", 10.0),
                                  ("s", 1, "Kursi", "error", None, None)],
                                 "session_id string, line_index int, raw_text string, source string, product_id string, price double")
    new = spark.createDataFrame([("s", 5, "meja kantor"), ("s", 6, "kursi"), ("t", 0, "Meja Kantor")],
                                "session_id string, line_index int, raw_text string")
    new.write.parquet(d + "/n")
    seen = []

    def handle(batch, batch_id):
        seen.extend(stream.cached_results_batch(batch, done).collect())

    q = spark.readStream.schema(new.schema).parquet(d + "/n").writeStream.foreachBatch(handle) \
        .trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="ckpt-")).start()
    q.awaitTermination(120)
    got = {(r.session_id, r.line_index): (r.cached, r.product_id) for r in seen}
    # same session + same normalised text reuses; an error result is not reused; other sessions do not share
    assert got == {("s", 5): (True, "7"), ("s", 6): (False, None), ("t", 0): (False, None)}


def _batches(path, frames):
    """Write each frame as one file, so that a stream with one file per trigger sees them as micro-batches in order."""
    import time

    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def _run_batches(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True) \
        .option("checkpointLocation", tempfile.mkdtemp(prefix="ckpt-")).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_first_answer_over_batches_equals_the_batch_twin(spark):
    from penawar.operators import route as route_ops

    d = tempfile.mkdtemp(prefix="first-")
    t0, m = dt.datetime(2024, 1, 1, 10, 0, 0), dt.timedelta(minutes=1)
    qschema = "session_id string, line_index int, asked_at timestamp"
    cschema = "session_id string, line_index int, type string, id string, url string, at timestamp, event_id long"
    q1 = [("s", 0, t0), ("s", 1, t0), ("s", 2, t0)]
    q2 = [("s", 3, t0 + m), ("z", 0, t0 + 180 * m)]  # the last one moves the watermark
    c1 = [("s", 0, "product", "7", None, t0 + 3 * m, 1), ("s", 3, "skip", None, None, t0 + 2 * m, 2)]  # an answer before its question arrives
    c2 = [("s", 0, "skip", None, None, t0 + 2 * m, 3),  # late, but earlier in event time
          ("s", 0, "skip", None, None, t0 + 2 * m, 3), ("s", 1, "product", "9", None, t0 + 9 * m, 4), ("z", 0, "skip", None, None, t0 + 181 * m, 5)]
    c3 = [("z", 9, "skip", None, None, t0 + 400 * m, 6)]
    _batches(d + "/q", [spark.createDataFrame(x, qschema) for x in (q1, q2, [("z", 8, t0 + 400 * m)])])
    _batches(d + "/c", [spark.createDataFrame(x, cschema) for x in (c1, c2, c3)])
    read = lambda p, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(p)
    out = _run_batches(spark, stream.first_answer(read(d + "/q", qschema), read(d + "/c", cschema)), "first_t1")
    got = {(r.session_id, r.line_index): (r.type, r.event_id, r.reason) for r in out.collect()}
    twin = route_ops.first_choice(spark.createDataFrame(q1 + q2, qschema), spark.createDataFrame(c1 + c2, cschema))
    want = {(s, k): (None, None, "input_timeout") for s, k, _ in q1 + q2} | {(r.session_id, r.line_index): (r.type, r.event_id, None) for r in twin.collect()}
    assert got == want == {("s", 0): ("skip", 3, None), ("s", 1): (None, None, "input_timeout"), ("s", 2): (None, None, "input_timeout"),
                           ("s", 3): ("skip", 2, None), ("z", 0): ("skip", 5, None)}


def test_cancel_and_last_leave_free_the_session(spark):
    d = tempfile.mkdtemp(prefix="free-")
    t0, m = dt.datetime(2024, 1, 1, 10, 0, 0), dt.timedelta(minutes=1)
    schema = "session_id string, event_id long, ts timestamp, kind string, end_at timestamp"
    one = [("a", 1, t0, "start", t0 + 60 * m), ("a", 2, t0 + m, "cancel", None), ("b", 3, t0, "join", None), ("b", 4, t0, "start", t0 + 60 * m)]
    two = [("a", 5, t0 + 2 * m, "start", t0 + 9 * m), ("a", 6, t0 + 3 * m, "start", t0 + 9 * m), ("b", 7, t0 + m, "leave", None), ("b", 8, t0 + 2 * m, "start", t0 + 9 * m)]
    _batches(d + "/e", [spark.createDataFrame(x, schema) for x in (one, two, [("z", 99, t0 + 600 * m, "join", None)])])
    out = _run_batches(spark, stream.session_guard(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d + "/e")), "free_t1")
    got = {r.event_id: r.outcome for r in out.collect()}
    assert got == {1: "accepted", 2: "cancelled", 3: "member", 4: "accepted", 5: "accepted", 6: "rejected", 7: "session_end", 8: "accepted"}


def test_a_run_of_several_days_outlives_the_expiry(spark):
    d = tempfile.mkdtemp(prefix="days-")
    t0, h = dt.datetime(2024, 1, 1, 10, 0, 0), dt.timedelta(hours=1)
    schema = "session_id string, event_id long, ts timestamp, kind string, end_at timestamp"
    z = [("z", 100 + k, t0 + k * 24 * h, "start", t0 + k * 24 * h + h) for k in range(8)]  # moves the watermark
    steps = [[("a", 1, t0, "start", t0 + 120 * h), ("b", 2, t0, "join", None), ("b", 3, t0, "join", None), z[0]], [z[2]], [z[3]],
             [("a", 4, t0 + 73 * h, "start", t0 + 74 * h), ("b", 5, t0 + 73 * h, "leave", None)], [z[6]], [z[7]], [("a", 6, t0 + 170 * h, "start", t0 + 171 * h)], [("z", 200, t0 + 300 * h, "start", t0 + 301 * h)]]
    _batches(d + "/e", [spark.createDataFrame(x, schema) for x in steps])
    out = _run_batches(spark, stream.session_guard(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d + "/e")), "days_t1")
    got = {r.event_id: r.outcome for r in out.collect()}
    ev = spark.createDataFrame([x for s in steps for x in s if x[3] == "start" and x[1] != 200], schema)
    starts = ev.select("session_id", F.col("event_id").alias("start_id"), F.col("ts").alias("start_at"), "end_at")
    twin = {r.start_id: ("accepted" if r.accepted else "rejected") for r in ses_ops.duplicate_start(starts).collect()}
    assert {k: got[k] for k in twin} == twin and (got[1], got[4], got[6]) == ("accepted", "rejected", "accepted")
    assert got[5] == "left"


def test_progress_counts_a_line_once(spark):
    d = tempfile.mkdtemp(prefix="prog2-")
    schema = "session_id string, line_index int"
    _batches(d + "/r", [spark.createDataFrame(x, schema) for x in ([("s", 0), ("s", 1)], [("s", 1), ("s", 2)])])
    totals = spark.createDataFrame([("s", 4)], "session_id string, total long")
    out = _run_batches(spark, stream.progress_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d + "/r"), totals), "prog_t2", "update")
    assert max(r.done for r in out.collect()) == 3


def test_repeats_in_one_batch_wait_for_their_donor(spark):
    batch = spark.createDataFrame([("s", 4, "Meja"), ("s", 5, " meja "), ("s", 6, "Kursi")], "session_id string, line_index int, raw_text string")
    done = spark.createDataFrame([("s", 0, "kursi", "auto_database", "7", 10.0)],
                                 "session_id string, line_index int, raw_text string, source string, product_id string, price double")
    got = {r.line_index: (r.cached, r.product_id, r.donor_index) for r in stream.cached_results_batch(batch, done).collect()}
    assert got == {4: (False, None, 4), 5: (True, None, 4), 6: (True, "7", None)}


# ---- shuffled arrival --------------------------------------------------------------------

def _read(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _state_rows(spark, df, name):
    """The result and the state rows after the last micro-batch."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True) \
        .option("checkpointLocation", tempfile.mkdtemp(prefix="ckpt-")).start()
    q.awaitTermination(240)
    return spark.table(name).collect(), [op["numRowsTotal"] for op in q.lastProgress["stateOperators"]]


def _shuffled(rows, parts, seed, at, slack):
    """The rows in ``parts`` files in an order that breaks event time by up to ``slack``."""
    import random

    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[at] + rng.random() * slack)
    n = -(-len(rows) // parts)
    return [rows[i:i + n] for i in range(0, len(rows), n)]


def test_guard_under_shuffled_arrival_equals_the_twins_and_frees_its_state(spark):
    import random

    rng = random.Random(7)
    d = tempfile.mkdtemp(prefix="order-")
    t0, m = dt.datetime(2024, 1, 1, 10, 0, 0), dt.timedelta(minutes=1)
    schema = "session_id string, event_id long, ts timestamp, kind string, end_at timestamp"
    rows = []
    for k in range(240):
        ts = t0 + rng.randrange(180) * m
        kind = rng.choice(["start", "start", "join", "leave"])
        rows.append((f"{kind[0] == 's'}{rng.randrange(6)}", k, ts, kind, ts + rng.randrange(40) * m if kind == "start" else None))
    last = [("z", 1000, t0 + dt.timedelta(days=1), "start", None), ("z", 1001, t0 + dt.timedelta(days=60), "start", None), ("z", 1002, t0 + dt.timedelta(days=61), "start", None)]
    files = _shuffled(rows, 3, 1, 2, 50 * m) + [[x] for x in last]
    _batches(d + "/e", [spark.createDataFrame(x, schema) for x in files])
    got, state = _state_rows(spark, stream.session_guard(_read(spark, d + "/e", schema)), "order_t1")
    got = {r.event_id: r.outcome for r in got}
    ev = spark.createDataFrame(rows, schema)
    starts = ev.where("kind = 'start'").select("session_id", F.col("event_id").alias("start_id"), F.col("ts").alias("start_at"), "end_at")
    twin = {r.start_id: ("accepted" if r.accepted else "rejected") for r in ses_ops.duplicate_start(starts).collect()}
    assert {k: got[k] for k in twin} == twin and "rejected" in twin.values()
    members = ev.where("kind <> 'start'").select("session_id", "event_id", "ts", F.expr("if(kind = 'join', 1, -1)").alias("delta"))
    ended = {r.session_id: r.event_id for r in ses_ops.last_leaver(members).collect()}
    ends = {}
    for s, k, ts, kind, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if got[k] == "session_end":
            ends.setdefault(s, k)
    assert ends == ended and ended
    assert sum(state) <= 1  # the closing session alone, although joins and leaves never balanced


def test_cancels_close_pending_questions_on_the_stream(spark):
    import random

    from penawar.operators import route as route_ops

    rng = random.Random(3)
    d = tempfile.mkdtemp(prefix="cancel-")
    t0, s = dt.datetime(2024, 1, 1, 10, 0, 0), dt.timedelta(seconds=1)
    qs, cs, ls = [], [], []
    for session in range(12):
        for line in range(12):
            at = t0 + rng.randrange(1800) * s
            ls.append((str(session), line, at))
            if rng.random() < 0.7:
                qs.append((str(session), line, at + rng.randrange(30) * s))
                if rng.random() < 0.6:
                    cs.append((str(session), line, rng.choice(["product", "skip"]), None, None, at + rng.randrange(500) * s, len(cs)))
        for _ in range(rng.randrange(3)):
            cs.append((str(session), None, "cancel", None, None, t0 + rng.randrange(1800) * s, len(cs)))
    qschema, lschema = "session_id string, line_index int, asked_at timestamp", "session_id string, line_index int, started_at timestamp"
    cschema = "session_id string, line_index int, type string, id string, url string, at timestamp, event_id long"
    end, later = t0 + 9000 * s, t0 + dt.timedelta(days=3)
    files = {"q": (qschema, _shuffled(qs, 3, 1, 2, 400 * s) + [[("z", 0, end)], [("z", 1, later)]]), "l": (lschema, _shuffled(ls, 3, 2, 2, 400 * s) + [[("z", 0, end)], [("z", 1, later)]]),
             "c": (cschema, _shuffled(cs, 3, 3, 5, 400 * s) + [[("z", 0, "skip", None, None, end, 9998)], [("z", 1, "skip", None, None, later, 9999)]])}
    for name, (schema, parts) in files.items():
        _batches(f"{d}/{name}", [spark.createDataFrame(x, schema) for x in parts])
    got, state = _state_rows(spark, stream.cancelled_questions(*[_read(spark, f"{d}/{k}", files[k][0]) for k in ("q", "c", "l")], lateness="30 minutes"), "cancel_t1")
    got = sorted((r.session_id, r.line_index, r.state, r.kind) for r in got if r.session_id != "z")
    twin = route_ops.cancel_session(*[spark.createDataFrame(x, y) for x, y in ((qs, qschema), (cs, cschema), (ls, lschema))])
    want = sorted((r.session_id, r.line_index, r.state, r.kind) for r in twin.collect())
    assert got == want and {x[2] for x in want} == {"answered", "cancelled", "open", "kept", "dropped"}
    assert sum(state) <= 1


def test_line_events_and_done(spark):
    from penawar.operators import quote

    d = tempfile.mkdtemp(prefix="events-")
    t0, m = dt.datetime(2024, 1, 1, 10, 0, 0), dt.timedelta(minutes=1)
    rschema, sschema = "session_id string, line_index int, at timestamp", "session_id string, total long, at timestamp"
    results = [(s, k, t0 + (3 * k + 1) * m) for s, n in (("a", 8), ("b", 5), ("c", 7)) for k in range(n)]
    sessions = [("a", 8, t0), ("b", 9, t0 + 2 * m), ("c", 7, t0 + 11 * m)]
    far = t0 + dt.timedelta(days=3)
    parts = _shuffled(results + results[2:6], 3, 5, 2, 20 * m) + [[("z", 0, far)], [("z", 1, far + dt.timedelta(days=3))]]
    _batches(d + "/r", [spark.createDataFrame(x, rschema) for x in parts])
    _batches(d + "/s", [spark.createDataFrame(x, sschema) for x in ([sessions[1]], [sessions[0]], [sessions[2]], [("z", 5, far)], [("y", 5, far + dt.timedelta(days=3))])])
    got, state = _state_rows(spark, stream.line_events(_read(spark, d + "/r", rschema), _read(spark, d + "/s", sschema)), "events_t1")
    lines = sorted((r.session_id, r.line_index) for r in got if r.event == "line_done" and r.session_id < "y")
    assert lines == sorted((s, k) for s, k, _ in results)  # repeats count once
    assert sorted(r.session_id for r in got if r.event == "done") == ["a", "c"]
    twin = quote.session_progress(spark.createDataFrame([(s, k) for s, n, _ in sessions for k in range(n)], "session_id string, line_index int"),
                                  spark.createDataFrame([(s, k) for s, k, _ in results], "session_id string, line_index int"))
    want = {r.session_id: (r.done, r.total, r.percent) for r in twin.collect()}
    top = {}
    for r in got:
        if r.session_id < "y" and r.total is not None:
            top[r.session_id] = max(top.get(r.session_id, (0, 0, 0)), (r.done, r.total, r.percent))
    assert top == {k: tuple(v) for k, v in want.items()}
    assert max(state) <= 4  # the closing sessions only


def test_cache_state_gives_results_to_repeats(spark):
    d = tempfile.mkdtemp(prefix="cached-")
    t0, m = dt.datetime(2024, 1, 1, 10, 0, 0), dt.timedelta(minutes=1)
    lschema = "session_id string, line_index int, raw_text string, at timestamp"
    rschema = "session_id string, line_index int, raw_text string, source string, product_id string, price double, at timestamp"
    far = [("z", 0, "x", t0 + dt.timedelta(days=3))]
    lines = [[("s", 0, "Meja", t0), ("s", 1, "Kursi", t0), ("t", 0, "Meja", t0), ("s", 4, "Lampu", t0)],
             [("s", 2, " meja ", t0 + m), ("s", 3, "KURSI", t0 + m), ("s", 5, "lampu", t0 + m)], [("s", 6, "meja", t0 + 3 * m), ("s", 7, "kursi", t0 + 3 * m)], far]
    results = [[("t", 9, "Buku", "not_found", None, None, t0)], [("s", 0, "Meja", "auto_database", "7", 10.0, t0 + m), ("s", 1, "Kursi", "error", None, None, t0 + m)],
               [("s", 3, "KURSI", "skipped", None, None, t0 + 2 * m)], [("z", 1, "y", "skipped", None, None, t0 + dt.timedelta(days=3))]]
    _batches(d + "/l", [spark.createDataFrame(x, lschema) for x in lines])
    _batches(d + "/r", [spark.createDataFrame(x, rschema) for x in results])
    got, state = _state_rows(spark, stream.cached_results(_read(spark, d + "/l", lschema), _read(spark, d + "/r", rschema)), "cached_t1")
    got = {(r.session_id, r.line_index): (r.cached, r.source, r.product_id, r.price) for r in got if r.session_id != "z"}
    ask = (False, None, None, None)
    assert got == {("s", 0): ask, ("s", 1): ask, ("t", 0): ask, ("s", 4): ask, ("s", 2): (True, "auto_database", "7", 10.0), ("s", 3): ask,  # called again after the error
                   ("s", 6): (True, "auto_database", "7", 10.0), ("s", 7): (True, "skipped", None, None),
                   ("s", 5): ask}  # its donor's result never came: released when the key expired
    assert sum(state) <= 2
