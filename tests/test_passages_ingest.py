"""Passages (I1) cleaning edge rows, stable ids, upsert (S9), high-water (A3), ingest job."""

from __future__ import annotations

import datetime as dt
import hashlib

import pandas as pd
from pyspark.sql import functions as F

from wardlight.operators.ingest import changed_rows, hashing_embedder, high_water, point_store, run_incremental_ingest, \
    upsert
from wardlight.operators.passages import build_passages
from wardlight.session import scratch_path
from wardlight.sources.mapping import EntityMapping

T0 = dt.datetime(2024, 3, 1, 12, 0)


def _mapping():
    return EntityMapping("things", "things", {
        "id": "id", "tenant": "tenant_id", "patient": "patient_id", "title": "headline", "note": "note",
        "fcmToken": "fcm_token", "googleDrivePath": "drive_path", "facebookUrl": "fb_url",
        "firstName": "first_name", "lastName": "last_name", "score": "score"})


def _rows(spark):
    hex32, hex31, hex40 = "a" * 32, "b" * 31, "ABCDEF0123" * 4
    data = [
        (1, "t1", 7, "Hello", "  padded\t", "tok", "p", "u", "Ann", "Lee", 23.0),
        (2, "", 0, None, "", "tok", "p", "u", "Bo", None, 2.5),
        (3, None, None, None, "   ", None, None, None, None, None, None),
        (4, "t2", 9, "x" * 500, "y" * 501, None, None, None, hex32, hex31, 1.0),
        (5, "t2", 9, hex40.lower(), "123e4567-e89b-12d3-a456-426614174000", None, None, None,
         "data:image/png;base64,AAAA", hex40, 0.0),
    ]
    return spark.createDataFrame(data, "id long, tenant_id string, patient_id long, headline string, note string, "
                                 "fcm_token string, drive_path string, fb_url string, first_name string, "
                                 "last_name string, score double") \
        .withColumn("updated_at", F.lit(T0).cast("timestamp_ntz"))


def test_cleaning_rules(spark):
    rows = {r["record_id"]: r for r in build_passages(_rows(spark), _mapping(), tenant_arg="argT").collect()}
    r1 = rows["1"]
    assert r1["text"] == ("id: 1, tenant: t1, patient: 7, title: Hello, note: padded, firstName: Ann, "
                          "lastName: Lee, score: 23")                     # token/path/url keys dropped
    assert r1["title"] == "Lee"                                           # last name-like column wins
    assert r1["tenant_id"] == "t1" and r1["patient_id"] == 7
    r2 = rows["2"]
    assert r2["tenant_id"] == "argT"                                      # "" falls to the argument
    assert r2["patient_id"] is None                                       # 0 is falsy
    assert r2["title"] == "Bo"                                            # lastName null → firstName
    assert "note" not in r2["text"] and "score: 2.5" in r2["text"]
    r3 = rows["3"]
    assert r3["text"] == "id: 3" and r3["title"] == "id: 3"               # blanks only → dropped
    r4 = rows["4"]
    assert "title: " + "x" * 500 in r4["text"] and "y" * 501 not in r4["text"]
    assert "firstName" not in r4["text"] and "lastName: " + "b" * 31 in r4["text"]
    r5 = rows["5"]
    assert "title" not in r5["text"].split(", ")[3] and "note: 123e4567-e89b" in r5["text"]  # uuid kept
    assert "data:image" not in r5["text"] and "ABCDEF" not in r5["text"] and "score: 0" in r5["text"]
    key = "things:t1:1"
    h = hashlib.md5(key.encode()).hexdigest()
    assert r1["id"] == f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def test_text_cut_and_title_fallback(spark):
    df = spark.createDataFrame([(1, "z" * 450), ], "id long, body string") \
        .withColumn("body2", F.lit("w" * 450))
    m = EntityMapping("n", "notes", {"id": "id", "body": "body", "more": "body2", "again": "body", "x": "body2",
                                     "y": "body"})
    r = build_passages(df, m).first()
    assert len(r["text"]) == 2000 and r["title"] == r["text"][:100] and r["tenant_id"] == "default"


def test_upsert_newest_wins_idempotent_and_high_water(spark):
    m = EntityMapping("a", "appts", {"id": "id", "tenant": "tenant_id", "status": "status"})
    base = spark.createDataFrame([(1, "t", "open", T0), (2, "t", "open", T0)],
                                 "id long, tenant_id string, status string, updated_at timestamp_ntz")
    store = build_passages(base, m)
    newer = spark.createDataFrame([(1, "t", "done", T0 + dt.timedelta(days=2)),
                                   (1, "t", "mid", T0 + dt.timedelta(days=1)),
                                   (3, "t", "open", T0 - dt.timedelta(days=9))],   # late row, still upserted
                                  "id long, tenant_id string, status string, updated_at timestamp_ntz")
    inc = build_passages(newer, m)
    once = upsert(store, inc)
    twice = upsert(once, inc)
    got = {r["record_id"]: r["text"] for r in once.collect()}
    assert got == {"1": "id: 1, tenant: t, status: done", "2": "id: 2, tenant: t, status: open",
                   "3": "id: 3, tenant: t, status: open"}
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    hw = high_water(inc, high_water(store)).first()
    assert hw["high_water"] == T0 + dt.timedelta(days=2)
    # checkpoint compare is strict: a row equal to the mark is not re-read, overlap re-reads it
    state = spark.createDataFrame([("t", "appts", T0)], "tenant_id string, table_name string, high_water timestamp_ntz")
    assert changed_rows(base, "appts", state).count() == 0
    assert changed_rows(base, "appts", state, overlap=dt.timedelta(minutes=1)).count() == 2
    assert changed_rows(base, "appts", state, resync=True).count() == 2


def test_ingest_job_end_to_end_with_quarantine(spark):
    root = scratch_path(spark, "ingest-test")
    m = EntityMapping("a", "appts", {"id": "id", "tenant": "tenant_id", "status": "status"})
    v1 = spark.createDataFrame([(i, f"t{i % 2}", "bad" if i == 3 else "ok", T0 + dt.timedelta(hours=i))
                                for i in range(6)], "id long, tenant_id string, status string, updated_at timestamp_ntz")
    good = hashing_embedder(16)
    calls = spark.sparkContext.accumulator(0)

    def flaky(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError("endpoint refused")
        return good(texts)

    out = run_incremental_ingest(spark, {"a": (v1, m)}, root + "/store", root + "/state", [flaky])
    assert out["processed"] == 5 and out["failed"] == 1
    assert calls.value <= 6 + 6      # one batch call + one per-row retry pass: the embedder ran once
    store = point_store(spark, out["store"]).read()
    assert store.count() == 5 and store.where(F.size("embedding") != 16).count() == 0
    # second run: nothing new; the quarantined row is replayed and fails again (kept in quarantine)
    out2 = run_incremental_ingest(spark, {"a": (v1, m)}, root + "/store", root + "/state", [flaky])
    assert out2["processed"] == 0 and out2["failed"] == 1
    # third run: the replayed failure now succeeds through the fallback embedder
    out3 = run_incremental_ingest(spark, {"a": (v1, m)}, root + "/store", root + "/state", [flaky, good])
    assert out3["processed"] == 1 and out3["failed"] == 0
    assert point_store(spark, out3["store"]).read().count() == 6
    # a newer version of a row replaces the stored one
    v2 = v1.union(spark.createDataFrame([(3, "t1", "fixed", T0 + dt.timedelta(days=3))], v1.schema))
    out4 = run_incremental_ingest(spark, {"a": (v2, m)}, root + "/store", root + "/state", [good])
    assert out4["processed"] == 1
    st = point_store(spark, out4["store"]).read()
    assert st.count() == 6 and st.where("record_id = '3'").first()["text"].endswith("fixed")


def test_ingest_stream_with_embedder_equals_batch_passages(spark):
    from wardlight.sources.tables import DRIVER_MAPPINGS, Catalog
    from wardlight.streaming.jobs import ingest_stream, table_stream
    sf = "/root/testdata/sf0.001"
    cat = Catalog(spark, sf)
    root = scratch_path(spark, "t-ingest-stream")
    src = table_stream(spark, sf, "orders", cat.raw("orders").schema)
    q = ingest_stream(Catalog.bind_appointments(src), DRIVER_MAPPINGS["appointments"], root + "/store",
                      root + "/ck", embedders=[hashing_embedder(8)])
    q.awaitTermination(300)
    assert q.exception() is None
    store = point_store(spark, root + "/store").read()
    batch = build_passages(cat.appointments(), DRIVER_MAPPINGS["appointments"])
    assert store.count() == batch.count()
    assert store.where(F.size("embedding") != 8).count() == 0
    assert store.select("id", "text").subtract(batch.select("id", "text")).count() == 0


def test_ingest_recovers_from_a_crashed_uncommitted_version(spark):
    root = scratch_path(spark, "ingest-crash")
    m = EntityMapping("a", "appts", {"id": "id", "tenant": "tenant_id", "status": "status"})
    v1 = spark.createDataFrame([(i, "t", "ok", T0 + dt.timedelta(hours=i)) for i in range(4)],
                               "id long, tenant_id string, status string, updated_at timestamp_ntz")
    # a crashed earlier attempt left a run and a manifest that was never published
    spark.createDataFrame([(1, 0)], "x int, bucket int").write.partitionBy("bucket").parquet(root + "/store/data/0123")
    import os
    os.makedirs(root.replace("file:", "") + "/store/commits")
    with open(root.replace("file:", "") + "/store/commits/_0123", "w") as f:
        f.write('{"version": 0, "entr')
    out = run_incremental_ingest(spark, {"a": (v1, m)}, root + "/store", root + "/state", [hashing_embedder(4)])
    assert out["processed"] == 4 and out["version"] == 0
    assert point_store(spark, out["store"]).read().count() == 4


def test_upsert_matches_a_python_model_on_random_batches(spark):
    import random
    rnd = random.Random(11)
    cols = "id string, tenant_id string, table_name string, record_id string, patient_id long, " \
           "title string, text string, updated_at timestamp_ntz"

    def row(i, day, txt):
        return (f"p{i}", "t", "x", str(i), None, txt, txt, T0 + dt.timedelta(days=day))

    store = [row(i, rnd.randrange(0, 5), f"s{i}") for i in range(0, 60, 2)]
    incoming = [row(rnd.randrange(0, 80), rnd.randrange(0, 9), f"n{k}") for k in range(120)]
    model = {}
    for r in store + incoming:              # the newest version wins, stored or incoming (ties: greatest text)
        cur = model.get(r[0])
        if cur is None or (r[7], r[6]) > (cur[7], cur[6]):
            model[r[0]] = r
    s_df = spark.createDataFrame(store, cols)
    i_df = spark.createDataFrame(incoming, cols)
    once = upsert(s_df, i_df)
    got = {r["id"]: tuple(r) for r in once.collect()}
    assert got == model
    assert {r["id"]: tuple(r) for r in upsert(once, i_df).collect()} == model   # replay-safe


def test_zoned_timestamps_render_in_utc(spark):
    from pyspark.sql import types as T
    from wardlight.functions.text import js_string
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP '2024-03-10 01:30:00' AS z, TIMESTAMP_NTZ '2024-03-10 01:30:00' AS n")
        r = df.select(js_string(F.col("z"), T.TimestampType()).alias("z"),
                      js_string(F.col("n"), T.TimestampNTZType()).alias("n")).first()
        assert r["z"] == "2024-03-10T06:30:00.000Z"     # 01:30 New York (EST) is 06:30 UTC
        assert r["n"] == "2024-03-10T01:30:00.000Z"     # wall-clock values keep their digits
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
