"""Query-log rules on the reference's question corpora, reply repair, requests, sessions,
request windows and the exact rate limiter (batch and stream) against pure-Python references."""

from __future__ import annotations

import datetime as dt
import json
from collections import deque

from pyspark.sql import functions as F

from wardlight.operators.querylog import label_queries, normalise_requests, parse_structured, route_actions
from wardlight.operators.ratelimit import epoch_micros, rate_limit, requests_in_window
from wardlight.operators.sessions import clear_sessions, session_history
from wardlight.session import scratch_path
from wardlight.sources.tables import Catalog
from wardlight.streaming.jobs import rate_limit_stream, run_to_table, session_history_stream

SF = "/root/testdata/sf0.001"

# Sample questions that the labels must be equal on (parity inputs).
QUESTIONS = {
    "How many doctors are available today?": ("aggregate", "doctors"),
    "Total number of patients registered last week.": ("aggregate", "patients"),
    "How many pending appointments are there?": ("aggregate", "appointments"),
    "Show all cardiologists.": ("list", "appointments"),
    "List patients who had appointments yesterday.": ("list", "patients"),
    "Fetch prescriptions for patient Ravi.": ("list", "patients"),
    "Show me the last 5 appointments.": ("list", "appointments"),
    "Give me the contact details of Dr. Ravi.": ("lookup", "appointments"),
    "Who is Dr. Ravi?": ("semantic_lookup", "appointments"),
    "Tell me about the patient named Sam.": ("semantic_lookup", "patients"),
    "What is the biography of the senior-most doctor?": ("lookup", "doctors"),
    "Describe the types of prescriptions Dr. Ravi gives.": ("lookup", "prescriptions"),
    "Export prescription of Ravi as PDF": ("export_pdf", "prescriptions"),
    "I want to book an appointment with Dr. Smith": ("book", "appointments"),
    "What is the discount on order 5?": ("aggregate", "appointments"),   # "count" inside "discount"
    "how many patients and doctors are there?": ("aggregate", "patients"),
}


def test_labels_on_question_corpus(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "qid int, query string")
    got = {r["query"]: (r["operation"], r["target"]) for r in label_queries(df).collect()}
    assert got == QUESTIONS
    whole = label_queries(df, whole_word=True).where(F.col("query").startswith("What is the discount")).first()
    assert whole["operation"] == "lookup"
    pdf = label_queries(df).where(F.col("query").startswith("Export")).first()
    assert pdf["targets"] == ["prescriptions"]


def test_routes(spark):
    df = spark.createDataFrame([(1, "lookup", ["doctors", "prescriptions"]), (2, "semantic_lookup", ["doctors"]),
                                (3, "weird", []), (4, "export_pdf", ["prescriptions"])],
                               "qid int, operation string, targets array<string>")
    got = sorted((r["qid"], r["priority"], r["action_type"], r["description"])
                 for r in route_actions(spark, df, ["qid"]).collect())
    assert got == [(1, 1, "sql", "Execute SQL for lookup on doctors, prescriptions"),
                   (1, 2, "pdf", "Generate prescription PDF document"),
                   (2, 1, "sql", "Check structured data for entity details"),
                   (2, 2, "vector", "Search vector knowledge base for bio/descriptions"),
                   (3, 1, "sql", "Default SQL execution"),
                   (4, 1, "sql", "Execute SQL for export_pdf on prescriptions"),
                   (4, 2, "pdf", "Generate prescription PDF document")]


def test_reply_parsing_and_repair(spark):
    replies = [
        '{"operation":"list","targets":["patients"],"filters":{"limit":0},"justification":"j"}',
        'Here: {"operation":"aggregate","targets":["appointments"],"filters":{"date":"today"}} ok',
        "no braces at all",
        "} then {",
        '{"operation":"lookup","targets":"doctors","filters":{"prescriptionFor":"Sam","limit":0}}',
        '{"operation": nope}',
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    r = {x["i"]: x for x in parse_structured(df).collect()}
    assert r[0]["parse_ok"] and r[0]["operation"] == "list" and r[0]["row_limit"] == 0.0
    assert r[1]["operation"] == "aggregate" and r[1]["justification"] == "Automatically inferred intent"
    assert r[1]["date"] == "today" and r[1]["row_limit"] == 5.0 and r[1]["targets"] == ["appointments"]
    assert r[2]["error"].startswith("No valid JSON") and r[3]["error"].startswith("No valid JSON")
    assert r[4]["targets"] == [] and r[4]["patient_name"] == "Sam" and r[4]["row_limit"] == 5.0
    assert not r[5]["parse_ok"] and r[5]["error"] == "JSON Parse error"


def test_request_normalisation(spark):
    bodies = [{"query": "", "user_query": "hi", "tenant_id": "7"}, {"q": "yo", "sessionId": "s"},
              {"tenantId": "3"}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    r = {x["i"]: x for x in normalise_requests(df).collect()}
    assert (r[0]["query"], r[0]["tenant_id"], r[0]["error"]) == ("hi", "7", None)
    assert (r[1]["query"], r[1]["tenant_id"], r[1]["session_id"]) == ("yo", "default", "s")
    assert r[2]["query"] is None and r[2]["error"].startswith("Query is required")


def test_session_history_9_10_11(spark):
    rows = [(s, i, "user" if i % 2 == 0 else ("system" if i == 3 else "assistant"), f"m{i}")
            for s, n in (("a", 9), ("b", 10), ("c", 11)) for i in range(n)]
    m = spark.createDataFrame(rows, "session_id string, seq long, role string, content string")
    h = {r["session_id"]: r["history"].split("\n") for r in session_history(m, 10).collect()}
    assert len(h["a"]) == 9 and len(h["b"]) == 10 and len(h["c"]) == 10
    assert h["c"][0] == "Assistant: m1" and h["a"][3] == "Assistant: m3" and h["a"][0] == "User: m0"
    left = clear_sessions(m, spark.createDataFrame([("b",)], "session_id string"))
    assert left.where("session_id = 'b'").count() == 0 and left.count() == 20


def _limiter(events, window_us, max_requests):
    out, rings = {}, {}
    for eid, key, us in sorted(events, key=lambda x: (x[1], x[2], x[0])):
        ring = rings.setdefault(key, deque())
        while ring and ring[0] <= us - window_us:
            ring.popleft()
        ok = len(ring) < max_requests
        if ok:
            ring.append(us)
        out[eid] = ok
    return out


def test_rate_limit_edges_and_brute_force(spark):
    W = 60_000_000
    base = dt.datetime(2024, 1, 1)
    ev = [(1, 1, base), (2, 1, base + dt.timedelta(seconds=1)), (3, 1, base + dt.timedelta(seconds=2)),
          (4, 1, base + dt.timedelta(seconds=60)),        # first stamp exactly at now - window → outside
          (5, 1, base + dt.timedelta(seconds=60.5)),       # rejected (3 accepted in window)
          (6, 1, base + dt.timedelta(seconds=62))]         # later accept once old stamps leave
    df = spark.createDataFrame(ev, "event_id long, key long, ts timestamp_ntz")
    got = {r["event_id"]: r["accepted"] for r in rate_limit(df, W, 3).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True}
    req = Catalog(spark, SF).requests()
    pdf = req.select("event_id", "key", epoch_micros("ts").alias("us")).collect()
    want = _limiter([(r[0], r[1], r[2]) for r in pdf], 86_400_000_000, 3)
    got = {r["event_id"]: r["accepted"] for r in rate_limit(req, 86_400_000_000, 3, num_partitions=3).collect()}
    assert got == want
    # the same decisions for several windows, contended in different places
    for w_us in (3_600_000_000, 86_400_000_000, 7 * 86_400_000_000):
        ref = _limiter([(r[0], r[1], r[2]) for r in pdf], w_us, 2)
        seg = {r["event_id"]: r["accepted"] for r in rate_limit(req, w_us, 2).collect()}
        assert seg == ref, w_us
    # property: at most max accepted stamps in any window
    acc = sorted((r[1], r[2]) for r in pdf if want[r[0]])
    for i in range(len(acc)):
        j = i
        while j < len(acc) and acc[j][0] == acc[i][0] and acc[j][1] < acc[i][1] + 86_400_000_000:
            j += 1
        assert j - i <= 3


def test_requests_in_window_halo_equals_plain_window(spark):
    req = Catalog(spark, SF).requests()
    W = 3_600_000_000
    a = {r["event_id"]: r["n_in_window"] for r in requests_in_window(req, W, bucket_us=W).collect()}
    p = {r["event_id"]: r["n_in_window"] for r in requests_in_window(req, W, hot_window_rows=None).collect()}
    assert p == a                                  # prefix-count (hot-key) form == halo form
    rows = req.select("event_id", "key", epoch_micros("ts").alias("us")).collect()
    by = {}
    for e, k, u in rows:
        by.setdefault(k, []).append(u)
    want = {e: sum(1 for x in by[k] if u - W < x <= u) for e, k, u in rows}
    assert a == want


def test_streams_equal_batch(spark):
    cat = Catalog(spark, SF)
    from wardlight.streaming.jobs import table_stream
    src = table_stream(spark, SF, "events", cat.raw("events").schema)
    out = scratch_path(spark, "t-rl")
    run_to_table(rate_limit_stream(Catalog.bind_requests(src), 86_400_000_000, 3), out + "/d", out + "/c")
    s = {r["event_id"]: r["accepted"] for r in spark.read.parquet(out + "/d").collect()}
    b = {r["event_id"]: r["accepted"] for r in rate_limit(cat.requests(), 86_400_000_000, 3).collect()}
    assert s == b
    src2 = table_stream(spark, SF, "conversations", cat.raw("conversations").schema)
    out2 = scratch_path(spark, "t-hist")
    run_to_table(session_history_stream(Catalog.bind_messages(src2), 3), out2 + "/d", out2 + "/c",
                 output_mode="update")
    got = {}
    for r in spark.read.parquet(out2 + "/d").orderBy("_epoch").collect():
        got[r["session_id"]] = r["history"]
    want = {r["session_id"]: r["history"] for r in session_history(cat.messages(), 3).collect()}
    assert got == want


def test_streams_carry_state_across_micro_batches(spark):
    """Input split into ordered files, one file per trigger: state must carry between batches
    (run under a non-UTC session zone: watermark and state timeout must share one clock)."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        _carry_state_check(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _carry_state_check(spark):
    import time as _time
    cat = Catalog(spark, SF)
    ev = cat.raw("events")
    folder = scratch_path(spark, "t-multi")
    # the events cover one month: four chunks of days, written in time order
    for i, (lo, hi) in enumerate([(1, 8), (8, 15), (15, 22), (22, 32)]):
        part = ev.where((F.dayofmonth("ts") >= lo) & (F.dayofmonth("ts") < hi))
        part.coalesce(1).write.parquet(f"{folder}/src/chunk{i}")
        _time.sleep(1.1)   # file streams pick files in modification order
    from wardlight.streaming.jobs import table_stream
    src = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(f"{folder}/src"))
    run_to_table(rate_limit_stream(Catalog.bind_requests(src), 86_400_000_000, 3), folder + "/rl", folder + "/ck")
    s = {r["event_id"]: r["accepted"] for r in spark.read.parquet(folder + "/rl").collect()}
    b = {r["event_id"]: r["accepted"] for r in rate_limit(cat.requests(), 86_400_000_000, 3).collect()}
    assert s == b
    assert table_stream is not None

    conv = cat.raw("conversations")
    for t in range(0, 8, 2):
        conv.where((F.col("turn") >= t) & (F.col("turn") < t + 2)).coalesce(1).write.parquet(f"{folder}/conv/t{t}")
        _time.sleep(1.1)
    csrc = (spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(f"{folder}/conv"))
    run_to_table(session_history_stream(Catalog.bind_messages(csrc), 3), folder + "/h", folder + "/ckh",
                 output_mode="update")
    got = {}
    for r in spark.read.parquet(folder + "/h").orderBy("_epoch").collect():
        got[r["session_id"]] = r["history"]
    want = {r["session_id"]: r["history"] for r in session_history(cat.messages(), 3).collect()}
    assert got == want


def test_idle_split_spreads_a_bursty_hot_key(spark):
    from wardlight.operators.ratelimit import contended_spans
    base = dt.datetime(2024, 1, 1)
    # one key, five bursts of 200 requests, bursts 10 minutes apart, window 1 minute
    rows = [(b * 1000 + i, 1, base + dt.timedelta(minutes=10 * b, milliseconds=50 * i))
            for b in range(5) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, key long, ts timestamp_ntz") \
        .withColumn("_us", epoch_micros("ts"))
    segs = contended_spans(df, 60_000_000, 7).select("_key", "_seg").distinct().count()
    assert segs == 5
    W = 60_000_000
    ref = _limiter([(r[0], r[1], r[2]) for r in df.select("event_id", "key", "_us").collect()], W, 7)
    got = {r["event_id"]: r["accepted"] for r in rate_limit(df.drop("_us"), W, 7).collect()}
    assert got == ref


def test_window_counts_dense_hot_key_with_ties(spark):
    base = dt.datetime(2024, 1, 1)
    # one key, 3000 requests in 5 minutes, many sharing the same millisecond; a second quiet key
    rows = [(i, 1, base + dt.timedelta(milliseconds=100 * (i // 3))) for i in range(3000)]
    rows += [(10_000 + i, 2, base + dt.timedelta(seconds=90 * i)) for i in range(5)]
    df = spark.createDataFrame(rows, "event_id long, key long, ts timestamp_ntz")
    W = 30_000_000
    us = {r[0]: (r[1], int((r[2] - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)) for r in rows}
    want = {e: sum(1 for k2, u2 in us.values() if k2 == k and u - W < u2 <= u) for e, (k, u) in us.items()}
    for hot in (None, 10 ** 9):
        got = {r["event_id"]: r["n_in_window"] for r in requests_in_window(df, W, hot_window_rows=hot).collect()}
        assert got == want, hot
