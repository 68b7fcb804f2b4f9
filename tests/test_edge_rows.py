"""Rows that the driver tables never show: null and text keys, late requests, odd replies and numbers,
bad vectors, replays in scope."""

import datetime as dt
import os
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.functions.numbering import number_within
from wardlight.functions.text import js_number
from wardlight.operators.bookings import resolve_bookings
from wardlight.operators.entity_query import entity_query
from wardlight.operators.ingest import hashing_embedder, point_store, run_incremental_ingest
from wardlight.operators.querylog import normalise_requests, parse_structured
from wardlight.operators.ratelimit import contended_spans, epoch_micros, rate_limit, requests_in_window
from wardlight.operators.vectors import search_store, vector_search, vector_topk_batch
from wardlight.plans.intent import Intent
from wardlight.session import checkpoint_root
from wardlight.sources.mapping import EntityMapping
from wardlight.streaming.jobs import drain, ingest_stream, rate_limit_stream, run_to_table

T0 = dt.datetime(2024, 1, 1)
SEC = 1_000_000


def at(s):
    return None if s is None else T0 + dt.timedelta(seconds=s)


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.fixture()
def requests(spark):
    rows = [(1, "ip:1", at(0)), (1, "ip:1", at(0)), (2, "ip:1", at(5)), (3, None, at(1)), (4, None, at(2)), (None, None, at(3)),
            (5, "ip:2", None), (6, "ip:2", at(500)), (7, "ip:2", at(1000)), (8, "ip:2", at(1001))]
    return spark.createDataFrame(rows, "event_id long, key string, ts timestamp_ntz")


def test_hot_and_cold_forms_agree_on_null_and_repeated_rows(requests):
    assert same(rate_limit(requests, 10 * SEC, 2), rate_limit(requests, 10 * SEC, 2, num_partitions=3))
    cold, hot = requests_in_window(requests, 10 * SEC), requests_in_window(requests, 10 * SEC, hot_window_rows=None)
    assert same(cold, hot) and cold.count() == requests.count()
    rows = requests.withColumn("o", F.monotonically_increasing_id())
    assert same(number_within(rows, "key", ["o"]), number_within(rows, "key", ["o"], hot_group_rows=None))


def test_limiter_keeps_text_keys(requests):
    got = {(r["event_id"], r["ts"]): (r["key"], r["accepted"]) for r in rate_limit(requests, 10 * SEC, 2).collect()}
    assert got[2, at(5)] == ("ip:1", False) and got[5, None] == ("ip:2", False) and got[3, at(1)] == (None, True)


def stream_of(spark, batches, schema):
    folder = f"{checkpoint_root(spark).removeprefix('file:')}/in-{uuid.uuid4().hex}"
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        pdf = spark.createDataFrame(rows, schema).toPandas()
        pdf.to_parquet(f"{folder}/{i}.parquet", coerce_timestamps="us")
        os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_requests_get_their_row(spark):
    schema = "event_id long, key string, ts timestamp_ntz"
    batches = [[(1, "a", at(10_000))], [(2, "b", at(20_000)), (3, "a", at(20_000))], [(4, "a", at(9_999)), (5, "c", at(0))]]
    out = f"{checkpoint_root(spark)}/late-{uuid.uuid4().hex}"
    run_to_table(rate_limit_stream(stream_of(spark, batches, schema), 10 * SEC, 1), out + "/d", out + "/c")
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(out + "/d").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True}       # 9,999 s lies in the window of 10,000 s


def streamed(spark, batches, window, most, **more):
    schema, out = "event_id long, key string, ts timestamp_ntz", f"{checkpoint_root(spark)}/late-{uuid.uuid4().hex}"
    run_to_table(rate_limit_stream(stream_of(spark, batches, schema), window * SEC, most, **more), out + "/d", out + "/c")
    return {r["event_id"]: r["accepted"] for r in spark.read.parquet(out + "/d").collect()}


def test_late_requests_never_overfill_a_window(spark):
    falling = [[(i, "a", at(100 - i))] for i in range(5)]
    assert streamed(spark, falling, 60, 1) == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert streamed(spark, [[(0, "a", at(0))], [(1, "a", at(1000))], [(2, "a", at(1))]], 60, 1) == {0: True, 1: True, 2: False}
    assert streamed(spark, [[(0, "a", at(0))], [(1, "a", at(1000))], [(2, "a", at(500))]], 60, 1, lateness_us=600 * SEC)[2]
    rnd = random.Random(3)
    times = [rnd.randrange(120) for _ in range(60)]
    batches = [[(10 * b + i, "a", at(times[10 * b + i])) for i in range(10)] + ([(100, None, None)] if b == 2 else []) for b in range(6)]
    for most, late in ((2, 200), (3, 25)):
        got = streamed(spark, batches, 20, most, lateness_us=late * SEC)
        kept, newest, want = [], 0, {100: False}
        for b in batches:
            for e, _, _ in sorted((r for r in b if r[0] < 100), key=lambda r: (times[r[0]], r[0])):
                newest, now = max(newest, times[e]), sorted(kept + [times[e]])
                want[e] = times[e] >= newest - late and all(sum(x - 20 < y <= x for y in now) <= most for x in range(150))
                kept = now if want[e] else kept
        assert got == want


def test_limiter_without_contention_has_no_python(spark):
    rows = [(i, f"k{i % 3}", at(7 * i)) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp_ntz")
    calm, busy = rate_limit(df, 60 * SEC, 100), rate_limit(df, 60 * SEC, 2)
    assert "MapInPandas" not in calm._jdf.queryExecution().toString() and "MapInPandas" in busy._jdf.queryExecution().toString()
    assert calm.count() == 90 and calm.where("not accepted").count() == 0
    for most in (1, 2, 3, 4):
        kept, want = {}, {}
        for e, k, t in rows:
            inside = [x for x in kept.get(k, []) if x > t - dt.timedelta(seconds=60)]
            want[e] = len(inside) < most
            kept[k] = inside + [t] * want[e]
        assert {r["event_id"]: r["accepted"] for r in rate_limit(df, 60 * SEC, most).collect()} == want


def test_limiter_cuts_a_key_that_is_never_idle(spark):
    """One key, a request every second and three bursts: only the bursts are decided in order."""
    rows = [(i, 1, at(i)) for i in range(900)] + [(1000 + 100 * b + i, 1, at(200 + 250 * b + i / 50)) for b in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, key long, ts timestamp_ntz").withColumn("_us", epoch_micros("ts"))
    spans = contended_spans(df, 20 * SEC, 30)
    assert spans.select("_seg").distinct().count() == 3 and spans.count() < 900 / 2.5 / 2
    kept, want = [], {}
    for e, _, t in sorted(rows, key=lambda r: (r[2], r[0])):
        kept = [x for x in kept if x > t - dt.timedelta(seconds=20)]
        want[e] = len(kept) < 30
        kept += [t] * want[e]
    assert {r["event_id"]: r["accepted"] for r in rate_limit(df.drop("_us"), 20 * SEC, 30).collect()} == want


def test_a_stream_that_is_not_done_is_an_error(spark):
    schema = "event_id long, key string, ts timestamp_ntz"
    src = stream_of(spark, [[(i, "a", at(i))] for i in range(4)], schema)
    out = f"{checkpoint_root(spark)}/slow-{uuid.uuid4().hex}"
    with pytest.raises(TimeoutError):
        run_to_table(rate_limit_stream(src, SEC, 1), out + "/d", out + "/c", timeout_s=0.2)
    assert not spark.streams.active


def test_bookings_with_names_that_grow_when_lowered(spark):
    people = spark.createDataFrame([(1, "t", "İ", "x")], "id long, tenant_id string, first_name string, last_name string")
    wanted = [(0, "t", "İ", "İ", None)] + [(i, "t", "q" * i, "q" * i, None) for i in range(1, 41)]
    ok, no = resolve_bookings(spark.createDataFrame(wanted, "request_id long, tenant_id string, patient_name string, doctor_name string, date string"),
                              people, people, T0)
    assert [r["request_id"] for r in ok.collect()] == [0] and no.count() == 40


def test_batched_search_takes_text_ids_and_drops_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("p1", "t", [1.0, 0.0]), ("p2", "t", [1.0, 1.0]), ("p3", "t", None), ("p4", "t", [nan, 1.0]), ("p5", "t", [inf, 1.0]),
            ("p6", "t", [1.0]), ("p7", "t", []), ("p8", "t", [0.0, 0.0]), ("p9", "t", [None, 1.0])]
    points = spark.createDataFrame(rows, "id string, tenant_id string, embedding array<double>")
    asked = spark.createDataFrame([("q", "t", [1.0, 0.0]), ("r", "t", None), ("s", "t", [2.0])], "query_id string, tenant_id string, q_embedding array<double>")
    got = [tuple(r) for r in vector_topk_batch(asked, points, 5).orderBy("query_id", "rank").collect()]
    assert [(g[0], g[2]) for g in got] == [("q", "p1"), ("q", "p2"), ("s", "p6")]
    assert [r["id"] for r in vector_search(points, [1.0, 0.0], "t", 5).collect()] == ["p1", "p2"]


def test_replies_with_odd_values(spark):
    replies = ['{"operation":"list","targets":[],"filters":{"limit":"ten"}}', '{"operation":"list","filters":{"patient_name":"Ravi"}}',
               '{"operation":"list","filters":{"patient":"Mina"}}', '{"operation":"list","filters":{"limit":"7"}}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = parse_structured(df).orderBy("i").collect()
    assert [g["row_limit"] for g in got] == [5.0, 5.0, 5.0, 7.0] and [g["patient_name"] for g in got] == [None, "Ravi", "Mina", None]


def test_request_names_by_truth(spark):
    bodies = ['{"query":false,"q":"hi","tenantId":0,"tenant_id":"t9"}', '{"query":"","user_query":"x","sessionId":12}', "not json", None]
    got = normalise_requests(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [(g["query"], g["tenant_id"], g["session_id"]) for g in got] == [("hi", "t9", None), ("x", "default", "12")] + [(None, "default", None)] * 2
    assert [g["error"] is None for g in got] == [True, True, False, False]


def test_numbers_print_as_in_javascript(spark):
    cases = {12345678.9: "12345678.9", 0.0001: "0.0001", 23.0: "23", -1e7: "-10000000", 1e20: "100000000000000000000", 1e21: "1e+21",
             1e-7: "1e-7", 1.5e-7: "1.5e-7", 0.000001: "0.000001", 123456789012.25: "123456789012.25", 0.0: "0", -0.5: "-0.5", 1.5e300: "1.5e+300"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "d double, want string")
    for r in df.select(js_number(F.col("d")).alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_department_word_on_a_numeric_column(spark):
    rows = spark.createDataFrame([(1, "t", 3)], "id long, tenant_id string, dept int")
    m = {"appointments": EntityMapping("appointments", "appointments", {"id": "id", "department": "dept", "tenant": "tenant_id"})}
    ask = lambda d: entity_query({"appointments": rows}, m, Intent.of("aggregate", ["appointments"], department=d), "t", T0).first()["count"]
    assert ask("cardiology") == 0 and ask("3") == 1


APPTS = EntityMapping("a", "appts", {"id": "id", "tenant": "tenant_id", "status": "status"})
APPT_SCHEMA = "id long, tenant_id string, status string, updated_at timestamp_ntz"


def refuser():
    good = hashing_embedder(8)

    def embed(texts: pd.Series):
        if any("bad" in t for t in texts):
            raise RuntimeError("endpoint refused")
        return good(texts)
    return embed


def test_replay_stays_within_the_run(spark):
    root = f"{checkpoint_root(spark)}/replay-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, "A", "bad", at(0)), (2, "B", "bad", at(0)), (3, "A", "ok", at(0))], APPT_SCHEMA)
    run = lambda e, **k: run_incremental_ingest(spark, {"a": (rows, APPTS)}, root + "/store", root + "/state", e, **k)
    assert run(refuser())["failed"] == 2
    out = run(hashing_embedder(8), tenant="A")
    assert (out["processed"], out["failed"]) == (1, 0)
    assert {r["record_id"] for r in point_store(spark, out["store"]).read().collect()} == {"1", "3"}
    held = point_store(spark, root + "/store").quarantine()[1].collect()
    assert [r["record_id"] for r in held] == ["2"]
    assert run(hashing_embedder(8), tables=["other"])["processed"] == 0
    assert run(hashing_embedder(8))["processed"] == 1


def test_batch_then_stream_loses_nothing(spark):
    root = f"{checkpoint_root(spark)}/both-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(i, "A", "ok", at(0)) for i in range(3)], APPT_SCHEMA)
    for _ in range(2):
        run_incremental_ingest(spark, {"a": (rows, APPTS)}, root + "/store", root + "/state", hashing_embedder(8), resync=True)
    for n, batches in enumerate(([[(9, "A", "new", at(5))]], [[(10, "A", "bad", at(6))], [(11, "A", "later", at(7))]])):
        src = stream_of(spark, batches, APPT_SCHEMA)
        drain(ingest_stream(src, APPTS, root + "/store", f"{root}/ck{n}", embedders=[refuser()]))
    store = point_store(spark, root + "/store").read()
    assert {r["record_id"] for r in store.collect()} == {"0", "1", "2", "9", "11"}
    assert run_incremental_ingest(spark, {"a": (rows, APPTS)}, root + "/store", root + "/state", hashing_embedder(8))["processed"] == 1
    assert point_store(spark, root + "/store").read().count() == 6


def test_search_of_what_was_ingested(spark):
    root = f"{checkpoint_root(spark)}/search-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(i, "A" if i % 2 else "B", w, at(i)) for i, w in enumerate(
        ["sore throat", "broken arm", "broken leg and arm", "flu"])], APPT_SCHEMA)
    run_incremental_ingest(spark, {"a": (rows, APPTS)}, root + "/store", root + "/state", hashing_embedder(64))
    got = search_store(spark, root + "/store", "broken arm", hashing_embedder(64), "A").collect()
    assert [g["record_id"] for g in got] == ["1", "3"] and "broken arm" in got[0]["text"] and got[0]["score"] > got[1]["score"]
    assert "embedding" not in got[0].asDict() and got[0]["title"]
    with pytest.raises(ValueError):
        search_store(spark, root + "/none", "x", hashing_embedder(64), "A")


def test_checkpoint_folder_order():
    class Conf(dict):
        pass

    class Context:
        def __init__(self, master, folder=None):
            self.master, self.folder = master, folder

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, folder=None, **conf):
            self.conf, self.sparkContext = Conf(conf), Context(master, folder)

    assert checkpoint_root(Session("spark://host:7077", "hdfs:/b", **{"spark.checkpoint.dir": "hdfs:/a"})) == "hdfs:/a"
    assert checkpoint_root(Session("spark://host:7077", "hdfs:/b")) == "hdfs:/b"
    with pytest.raises(ValueError):
        checkpoint_root(Session("local-cluster[2,1,1024]"))
    assert os.path.isdir(checkpoint_root(Session("local[4]")))
