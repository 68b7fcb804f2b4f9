"""The point store: newest wins in any order, deltas and compaction, exclusive versions, vector cache."""

from __future__ import annotations

import datetime as dt
import random
import threading

import pandas as pd
from pyspark.sql import functions as F

from wardlight.operators.ingest import hashing_embedder, newest_per_id, point_store, run_incremental_ingest
from wardlight.operators.passages import build_passages
from wardlight.operators.point_store import Manifests, SmallTable
from wardlight.session import scratch_path
from wardlight.sources.mapping import EntityMapping
from wardlight.streaming.jobs import drain, ingest_stream

T0 = dt.datetime(2024, 1, 1)
ROWS = "id long, tenant_id string, status string, updated_at timestamp_ntz"
APPTS = EntityMapping("a", "appts", {"id": "id", "tenant": "tenant_id", "status": "status"})
POINTS = "id string, text string, updated_at timestamp_ntz"


def files_stream(spark, batches):
    """One file a batch, read one per trigger in the given order."""
    import time
    folder = scratch_path(spark, "t-files")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/{n}")
        time.sleep(1.1)
    return (spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder))


def texts(spark, root):
    return {r["record_id"]: r["text"].rsplit(" ", 1)[1] for r in point_store(spark, root).read().collect()}


def test_older_file_never_replaces_a_newer_row(spark):
    root = scratch_path(spark, "t-q1")
    src = files_stream(spark, [[(1, "t", "new", T0 + dt.timedelta(days=31))], [(1, "t", "old", T0), (2, "t", "only", T0)]])
    drain(ingest_stream(src, APPTS, root + "/store", root + "/ck"))
    assert texts(spark, root + "/store") == {"1": "new", "2": "only"}


def test_replayed_failure_loses_to_the_newer_version(spark):
    root = scratch_path(spark, "t-q2")
    good = hashing_embedder(8)

    def refuser(batch: pd.Series):
        if any("first" in t for t in batch):
            raise RuntimeError("refused")
        return good(batch)

    rows = spark.createDataFrame([(1, "t", "first", T0)], ROWS)
    assert run_incremental_ingest(spark, {"a": (rows, APPTS)}, root + "/store", root + "/state", refuser)["failed"] == 1
    drain(ingest_stream(files_stream(spark, [[(1, "t", "second", T0 + dt.timedelta(days=1))]]), APPTS, root + "/store", root + "/ck", [good]))
    out = run_incremental_ingest(spark, {"a": (rows, APPTS)}, root + "/store", root + "/state", good)
    assert (out["processed"], out["failed"]) == (1, 0)
    assert texts(spark, root + "/store") == {"1": "second"} and point_store(spark, root + "/store").quarantine() == ([], None)


def test_random_batches_equal_a_plain_model(spark):
    rnd = random.Random(8)
    root, model = scratch_path(spark, "t-model"), {}
    store = point_store(spark, root, buckets=4, max_deltas=2)
    for n in range(7):
        rows = [(f"p{rnd.randrange(40)}", f"{n}-{k}", None if rnd.random() < 0.1 else T0 + dt.timedelta(days=rnd.randrange(9)))
                for k in range(rnd.choice([1, 30]))]
        for r in rows:
            key = (r[2] is not None, r[2] or T0, r[1])
            if r[0] not in model or key > model[r[0]][0]:
                model[r[0]] = key, r
        assert store.merge(spark.createDataFrame(rows, POINTS)) == n
        assert {r["id"]: tuple(r) for r in store.read().collect()} == {i: r for i, (_, r) in model.items()}
    assert max(len(runs) for runs in store.manifests.current()["entries"].values()) <= 3
    first = store.read(0).count()
    assert first <= 30 and store.vacuum(1) > 0 and store.manifests.versions() == [6]
    assert store.read().count() == len(model)


def test_untouched_buckets_keep_their_files(spark):
    store = point_store(spark, scratch_path(spark, "t-buckets"), buckets=8, max_deltas=1)
    store.merge(spark.createDataFrame([(f"p{i}", "a", T0) for i in range(200)], POINTS))
    before = store.manifests.current()["entries"]
    for day in (1, 2):
        store.merge(spark.createDataFrame([("p7", f"day {day}", T0 + dt.timedelta(days=day))], POINTS))
    after = store.manifests.current()["entries"]
    changed = [b for b in before if before[b] != after[b]]
    assert len(before) == 8 and len(changed) == 1 and len(after[changed[0]]) == 1     # that one was compacted
    rows = {r["id"]: r["text"] for r in store.read().collect()}
    assert len(rows) == 200 and rows["p7"] == "day 2"


def test_two_writers_never_take_one_version(spark):
    root = scratch_path(spark, "t-race")
    point_store(spark, root).merge(spark.createDataFrame([("start", "x", T0)], POINTS))
    taken, errors = [], []

    def writer(name):
        try:
            for n in range(3):
                taken.append(point_store(spark, root, max_deltas=2).merge(spark.createDataFrame([(f"{name}{n}", name, T0), ("both", name, T0)], POINTS)))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(name,)) for name in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(taken) == [1, 2, 3, 4, 5, 6]
    assert {r["id"] for r in point_store(spark, root).read().collect()} == {"start", "both", "a0", "a1", "a2", "b0", "b1", "b2"}


def test_commit_is_built_anew_on_the_version_that_won(spark):
    root = scratch_path(spark, "t-commit")
    one, two, seen = Manifests(spark, root), Manifests(spark, root), []

    def slow(now):
        seen.append(now and now["who"])
        if len(seen) == 1:
            assert two.commit(lambda now: {"who": "two"}) == 0
        return {"who": "one"}

    assert one.commit(slow) == 1 and seen == [None, "two"] and one.current() == {"who": "one", "version": 1}
    assert not one.files.publish("commits/0000000001.json", "{}") and one.current()["who"] == "one"
    assert one.commit(lambda now: None) == 1
    table = SmallTable(spark, root + "/small")
    assert table.read() is None
    for _ in range(2):
        table.update(lambda old: spark.range(1 if old is None else old.count() + 1))
    assert table.read().count() == 2


def test_epoch_is_merged_once(spark):
    store = point_store(spark, scratch_path(spark, "t-epoch"))
    rows = spark.createDataFrame([("p", "a", T0)], POINTS)
    bad = spark.createDataFrame([("q", "b", T0)], POINTS)
    assert store.merge(rows, failed=bad, stream=("s", 0)) == 0
    assert store.merge(rows, failed=bad, stream=("s", 0)) == 0          # replayed after a crash
    assert store.quarantine()[1].count() == 1
    assert store.merge(rows, stream=("s", 1)) == 1 and store.merge(rows, stream=("other", 0)) == 2
    empty = point_store(spark, scratch_path(spark, "t-none"))
    assert empty.merge(rows.limit(0)) == 0 and empty.read().count() == 0


def test_cache_embeds_only_unseen_texts(spark):
    root, calls = scratch_path(spark, "t-cache"), spark.sparkContext.accumulator(0)
    plain = hashing_embedder(8)

    def counting(batch: pd.Series):
        calls.add(len(batch))
        return plain(batch)

    def run(status, day, **more):
        rows = spark.createDataFrame([(i, "t", status[i % len(status)], T0 + dt.timedelta(days=day)) for i in range(6)], ROWS)
        mapping = EntityMapping("a", "appts", {"status": "status"})
        return run_incremental_ingest(spark, {"a": (rows, mapping)}, root + "/store", root + "/state", counting, cache_root=root + "/vectors", **more)

    assert run(["a", "b"], 0)["processed"] == 6 and calls.value == 2
    assert run(["b", "a"], 1)["processed"] == 6 and calls.value == 2          # another row, a known text
    assert run(["a", "c"], 2, embed_parallelism=2)["processed"] == 6 and calls.value == 3
    stored = point_store(spark, root + "/store").read()
    assert stored.where(F.size("embedding") == 8).count() == 6
    assert run(["a", "c"], 2, resync=True)["processed"] == 6 and calls.value == 3


def test_rows_without_an_id_stay_apart(spark):
    rows = spark.createDataFrame([(None, "t", "one", T0), (None, "t", "two", T0), (None, "t", "two", T0)], ROWS)
    points = newest_per_id(build_passages(rows, APPTS))
    assert sorted(r["text"] for r in points.collect()) == ["tenant: t, status: one", "tenant: t, status: two"]
