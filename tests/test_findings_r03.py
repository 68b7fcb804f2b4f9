"""Tables kept as folders of part files, parts of a late stream and work that must not grow with copies."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wardlight.operators.answers import answer_questions, answer_records
from wardlight.functions import numbering
from wardlight.operators.documents import deal_by_tenant, first_source, prescription_document_lines, write_documents
from wardlight.operators.ingest import point_store
from wardlight.operators.vectors import BLOCK_BYTES, GRID, _blocks
from wardlight.plans.queries_streaming import _in_parts
from wardlight.session import scratch_path
from wardlight.sources.mapping import EntityMapping
from wardlight.streaming.jobs import _in_order, drain, run_to_table, session_history_stream, table_stream


def test_a_table_that_is_a_folder_of_part_files_is_streamed(spark):
    folder = scratch_path(spark, "parts")
    rows = spark.createDataFrame([("a", n, "user", f"m{n}") for n in range(6)], "session_id string, seq long, role string, content string")
    rows.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    spark.range(3).write.parquet(f"{folder}/events.parquet")
    src = table_stream(spark, folder, "conversations", rows.schema)
    run_to_table(session_history_stream(src, 2), folder + "/out", folder + "/_checkpoint", output_mode="update")
    assert [r["history"] for r in spark.read.parquet(folder + "/out").collect()] == ["User: m4\nUser: m5"]


def test_each_part_of_several_files_is_one_micro_batch(spark):
    folder, seen = scratch_path(spark, "late"), []

    def run(src):
        drain(src.writeStream.foreachBatch(lambda b, epoch: seen.append((epoch, b.count(), b.select(F.input_file_name()).distinct().count())))
              .option("checkpointLocation", folder + "/_checkpoint").trigger(availableNow=True).start())

    _in_parts(spark, [spark.range(90).repartition(3), spark.range(40).repartition(2)], folder + "/rows", run)
    assert seen == [(0, 90, 3), (1, 40, 2)]


def test_requests_are_ordered_as_by_both_columns():
    rng = np.random.default_rng(1)
    for us in (rng.permutation(50), rng.integers(0, 9, 50), np.where(rng.random(50) < 0.2, np.nan, rng.permutation(50))):
        batch = pd.DataFrame({"event_id": rng.permutation(50), "_us": us})
        pd.testing.assert_frame_equal(_in_order(batch), batch.sort_values(["_us", "event_id"], kind="stable"))


def test_large_tenants_have_a_grid_of_few_blocks(spark):
    rows = spark.range(3000).select((F.col("id") % 2).cast("string").alias("tenant_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert {r["n"] for r in _blocks(rows, "v", "n", 10).collect()} == {GRID}
    assert {r["n"] for r in _blocks(rows, "v", "n", 1000).collect()} == {2}
    wide = rows.withColumn("v", F.array_repeat(F.lit(1.0), BLOCK_BYTES // 800))
    assert {r["n"] for r in _blocks(wide, "v", "n", 10).collect()} == {15}       # 1500 rows, 100 to a block


def test_a_stored_bucket_is_written_with_one_exchange_and_old_stores_keep_their_hash(spark):
    root = scratch_path(spark, "one-exchange")
    store = point_store(spark, root, buckets=4)
    rows = spark.range(400).select(F.col("id").cast("string"), F.lit("t").alias("text"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    store.merge(rows)
    assert store.manifests.current()["hashed"] == "hash"
    old = {**store.manifests.current()}
    old.pop("hashed")
    other = point_store(spark, root + "-old", buckets=4)
    run, touched = other._write(rows, "xxhash64", 4)
    other.manifests.commit(lambda now: {**old, "entries": {b: [run] for b in touched}})
    other.merge(rows.withColumn("text", F.lit("u")))
    assert {(r["id"], r["text"]) for r in other.read().collect()} == {(str(n), "u") for n in range(400)}
    assert "hashed" not in old and other.manifests.current()["hashed"] == "xxhash64"


def _joined(df, by):
    """The columns that the plan's joins of one kind compare."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if by in line]


def _answers(spark):
    m = lambda n, **more: EntityMapping(n, n, {"id": "id", "tenant": "tenant", **more})
    tables = {"patients": spark.createDataFrame([(1, "t", "Ann", "Lee"), (2, "t", "Bo", "Lee")], "id long, tenant string, first string, last string"),
              "doctors": spark.createDataFrame([(7, "t", "Li", "Wu")], "id long, tenant string, first string, last string"),
              "appointments": spark.createDataFrame([(n, "t", 1 + n % 2, 7) for n in range(9)], "id long, tenant string, patient long, doctor long")}
    mappings = {"patients": m("patients", firstName="first", lastName="last"), "doctors": m("doctors", firstName="first", lastName="last"),
                "appointments": m("appointments", patient="patient", doctor="doctor")}
    asked = spark.createDataFrame([(1, "t", "list", None, "wu", "lee", None, None, None, None, 3.0), (2, "t", "aggregate", None, "wu", None, None, None, None, None, None),
                                   (3, "t", "list", "patients", None, "ann", None, None, None, None, None)],
                                  "question_id long, tenant_id string, operation string, target string, doctorName string, patientName string, "
                                  "department string, status string, date string, minExperience double, limit double")
    return tables, mappings, answer_questions(tables, mappings, asked, dt.datetime(2024, 3, 13))


def test_answers_broadcast_nothing_that_grows_with_questions_or_rows(spark):
    _, _, answers = _answers(spark)
    assert {r["question_id"]: (r["results_count"], r["record_ids"]) for r in answers.collect()} == {1: (3, ["0", "1", "2"]), 2: (9, None), 3: (1, ["1"])}
    assert _joined(answers, "SortMergeJoin")
    # only cells are: they meet the few sets of predicates without a name
    assert not [line for line in _joined(answers, "BroadcastHashJoin") if re.search("_needle#|_id#|sig#|patient#|doctor#", line)]


def test_listed_records_are_not_broadcast(spark):
    tables, mappings, answers = _answers(spark)
    rows = answer_records(tables, mappings, answers, "appointments")
    assert sorted((r["question_id"], r["rank"], r["id"]) for r in rows.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert not [line for line in _joined(rows, "BroadcastHashJoin") if "_id#" in line]


def _items(spark):
    return first_source([("a", spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "prescription_id long, line_no int, medicine_name string")), ("none", None),
                         ("b", spark.createDataFrame([(1, 3, "z"), (2, 1, "z"), (None, 1, "n")], "prescription_id long, line_no int, medicine_name string"))],
                        "prescription_id")


def test_the_first_source_is_found_without_sorting_candidates(spark):
    items = _items(spark)
    assert sorted((r["prescription_id"], r["line_no"], r["source_table"]) for r in items.collect()) == [(1, 1, "a"), (1, 2, "a"), (2, 1, "b")]
    assert _joined(items, "ShuffledHashJoin") and not _joined(items, "SortMergeJoin") and not _joined(items, "BroadcastHashJoin")


def test_items_are_numbered_by_more_tasks_the_more_there_are(spark, monkeypatch):
    monkeypatch.setattr(numbering, "TASK_ROWS", 10)
    rows = spark.range(200).select((F.col("id") % 50).alias("k"), "id")
    df = numbering.number_within(rows, "k", ["id"], "n", biggest=4, rows=200)
    assert "partitioning(k#" in df._jdf.queryExecution().executedPlan().toString() and ", 20)" in "".join(_joined(df, "Exchange"))
    assert all(r["n"] == r["id"] // 50 + 1 for r in df.collect())
    assert ", 20)" not in "".join(_joined(numbering.number_within(rows, "k", ["id"], "n", biggest=4, rows=80), "Exchange"))


def test_the_sink_exchanges_headers_and_items_instead_of_lines(spark):
    people = "id long, first_name string, last_name string, gender string, dob string"
    rx = spark.createDataFrame([(1, "t", 5, 6, None), (2, "t", 5, 6, None), (3, "u", 5, 6, None)], "id long, tenant_id string, patient_id long, doctor_id long, created_at timestamp")
    someone = lambda n: spark.createDataFrame([(n, "A", "B", None, None)], people)
    build = lambda **kw: prescription_document_lines(rx, someone(5), someone(6), _items(spark), **kw)
    lines, folder = build(deal=deal_by_tenant), scratch_path(spark, "dealt")
    plan = lines._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [n for n, line in enumerate(plan) if "RebalancePartitions" in line]
    assert len(at) == 2 and all(any("Generate" in line for line in plan[:n]) for n in at) and not any("Generate" in line for line in plan[at[1]:])
    write_documents(lines, folder, dealt=True)
    got = spark.read.parquet(folder)
    assert sorted(map(str, got.select(*lines.columns).collect())) == sorted(map(str, build().collect())) and got.count() == 27 + 6 + 1
