"""Vector top-k vs numpy brute force; bookings substring index vs a brute-force scan."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from wardlight.operators.bookings import resolve_bookings
from wardlight.operators.vectors import collection_stats, vector_search, vector_topk_batch
from wardlight.sources.tables import Catalog

SF = "/root/testdata/sf0.001"


def _brute(ids, tenants, X, k, exclude_self):
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = Xn @ Xn.T
    out = {}
    for i, q in enumerate(ids):
        cand = [(-S[i, j], ids[j]) for j in range(len(ids))
                if tenants[j] == tenants[i] and not (exclude_self and j == i)]
        out[q] = [c for _, c in sorted(cand)[:k]]
    return out


def test_batch_topk_equals_brute_force_across_block_sizes(spark):
    v = Catalog(spark, SF).vectors()
    pdf = v.toPandas()
    X = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    want = _brute(pdf["id"].tolist(), pdf["tenant_id"].tolist(), X, 5, True)
    q = v.select(F.col("id").alias("query_id"), "tenant_id", F.col("embedding").alias("q_embedding"))
    for block in (7, 64, 4096):
        got = {}
        for r in vector_topk_batch(q, v, k=5, exclude_self=True, block_rows=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
        got = {k_: [i for _, i in sorted(x)] for k_, x in got.items()}
        assert got == want, block


def test_single_query_zero_vectors_ties_and_small_tenants(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "a", [0.0, 0.0]), (4, "a", [0.0, 1.0]),
            (5, "b", [1.0, 0.0])]
    c = spark.createDataFrame(rows, "id long, tenant_id string, embedding array<float>")
    hits = vector_search(c, [1.0, 0.0], "a", k=3).collect()
    assert [h["id"] for h in hits] == [1, 2, 4]            # tie 1.0 → lower id first; zero vector dropped
    assert "embedding" not in hits[0].asDict()
    assert [h["id"] for h in vector_search(c, [1.0, 0.0], "b", k=5).collect()] == [5]  # fewer than k
    assert vector_search(c, [0.0, 0.0], "a").count() == 0
    q = c.select(F.col("id").alias("query_id"), "tenant_id", F.col("embedding").alias("q_embedding"))
    got = vector_topk_batch(q, c, k=2, block_rows=2).where("query_id = 1").orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2]
    st = {r["tenant_id"]: r["points"] for r in collection_stats(c).collect()}
    assert st == {"a": 4, "b": 1}


def test_bookings_equal_brute_force(spark):
    patients = spark.createDataFrame([
        (0, "t1", "Zero", "Zed"), (5, "t1", "Ravi", "Kumar"), (3, "t1", "Ravindra", "Rao"),
        (9, "t1", "Sam", "Ravi"), (4, "t2", "Ravi", "K"), (7, "t1", "Al%ce", "Under_score")],
        "id long, tenant_id string, first_name string, last_name string")
    doctors = spark.createDataFrame([(1, "t1", "Raju", "Boy"), (2, "t1", "Ana", "Bo"), (6, "t2", "Raju", "X")],
                                    "id long, tenant_id string, first_name string, last_name string")
    reqs = spark.createDataFrame([
        (1, "t1", "ravi", "bo", "2024-05-01"),      # several matches → lowest id (3); doctor Bo → 1 (Boy) and 2
        (2, "t1", "nobody", "raju", None),          # unknown patient
        (3, "t1", "ravi", "who", None),             # unknown doctor
        (4, "t1", "ze", "raju", None),              # matches id 0 → falsy → rejected
        (5, "t2", "ra", "ra", None),                # needle under 3 chars still exact
        (6, "t1", "%c", "raju", None),              # % is literal
        (7, "t1", "", "raju", None),                # empty name → not searched
        (8, "t1", "ravi", "raju", "2024-02-31"),    # impossible date → rejected
    ], "request_id long, tenant_id string, patient_name string, doctor_name string, date string")
    as_of = dt.datetime(2024, 3, 1, 9, 0)
    acc, rej = resolve_bookings(reqs, patients, doctors, as_of)
    acc = {r["request_id"]: (r["patient_id"], r["doctor_id"], r["scheduled_at"]) for r in acc.collect()}
    rej = {r["request_id"]: r["reason"] for r in rej.collect()}
    assert acc == {1: (3, 1, dt.datetime(2024, 5, 1)), 5: (4, 6, dt.datetime(2024, 3, 2, 9, 0)),
                   6: (7, 1, dt.datetime(2024, 3, 2, 9, 0))}
    assert rej == {2: "patient_not_found", 3: "doctor_not_found", 4: "patient_not_found",
                   7: "patient_not_found", 8: "invalid_date"}


def test_bookings_on_driver_tables_match_contains_scan(spark):
    cat = Catalog(spark, SF)
    ev = cat.raw("events")
    req = ev.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 5).cast("string").alias("tenant_id"),
                    F.substring(F.lpad((F.col("event_id") * 7 % 150).cast("string"), 3, "0"), 1, 3).alias("patient_name"),
                    F.lpad((F.col("user_id") % 10).cast("string"), 1, "0").alias("doctor_name"),
                    F.lit(None).cast("string").alias("date"))
    acc, rej = resolve_bookings(req, cat.patients(), cat.doctors(), dt.datetime(1998, 1, 1))
    got = {r["request_id"]: (r["patient_id"], r["doctor_id"]) for r in acc.collect()}
    P = [tuple(r) for r in cat.patients().select("id", "tenant_id", "first_name", "last_name").collect()]
    D = [tuple(r) for r in cat.doctors().select("id", "tenant_id", "first_name", "last_name").collect()]

    def first(rows, t, n):
        ids = [i for i, tt, f, l in rows if tt == t and (n in (f or "").lower() or n in (l or "").lower())]
        return min(ids) if ids else None
    want = {}
    for r in req.collect():
        p = first(P, r["tenant_id"], r["patient_name"].lower())
        d = first(D, r["tenant_id"], r["doctor_name"].lower())
        if p and d:
            want[r["request_id"]] = (p, d)
    assert got == want
    assert acc.count() + rej.count() == req.count()


def test_collection_info_json_round_trip(spark, tmpdir_path):
    from wardlight.operators.vectors import write_collection_info
    stats = collection_stats(Catalog(spark, SF).vectors())
    write_collection_info(stats, tmpdir_path + "/info")
    back = spark.read.json(tmpdir_path + "/info")
    assert sorted(map(tuple, back.select("tenant_id", "points", "dim_min", "distance").collect())) == \
        sorted(map(tuple, stats.select("tenant_id", "points", "dim_min", "distance").collect()))


def test_arrow_and_sql_scoring_agree(spark):
    rows = [(1, "a", [1.0, 0.0, 2.0]), (2, "a", [0.0, 0.0, 0.0]), (3, "a", None), (4, "a", [1.0, 1.0]),
            (5, "a", [3.0, -1.0, 0.5])]
    c = spark.createDataFrame(rows, "id long, tenant_id string, embedding array<float>")
    q = [0.5, 0.25, 1.0]
    a = {r["id"]: r["score"] for r in vector_search(c, q, "a", k=10).collect()}
    s = {r["id"]: r["score"] for r in vector_search(c, q, "a", k=10, method="sql").collect()}
    assert a == s and set(a) == {1, 5}        # zero, null and wrong-size vectors score null
