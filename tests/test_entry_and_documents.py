"""Driver contract, documents on hand-written rows (S14 absent / empty candidates, no items)."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import subprocess
import sys

import __spark_entry__ as E
from wardlight.operators.documents import document_bodies, first_source, prescription_document_lines


def test_entry_and_registry_contract(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["count"] and len(rows) == 1 and rows[0]["count"] > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
    assert all(isinstance(s, str) and s.strip() for s in o.values())


def test_entry_without_the_training_data_part(tmpdir_path):
    """The entry imports, with all other queries, from a copy without llm/ (pipeline file kept or not)."""
    here = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(f"{here}/wardlight", f"{tmpdir_path}/wardlight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmpdir_path)
    say = "import __spark_entry__ as E; from wardlight.plans.registry import QUERIES as Q; print(set(E.queries()) == set(Q))"
    for extra in ([], ["corpus_pipeline.py"]):
        for name in extra:
            if os.path.exists(f"{here}/{name}"):
                shutil.copy(f"{here}/{name}", tmpdir_path)
        done = subprocess.run([sys.executable, "-c", say], cwd=tmpdir_path, capture_output=True, text=True, timeout=120,
                              env={**os.environ, "PYTHONPATH": tmpdir_path})
        assert done.stdout.strip() == "True", done.stderr


def test_every_query_runs_on_smallest_tables(spark):
    for name, fn in E.queries().items():
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.columns, name
        df.limit(1).collect()


def test_documents_candidates_and_missing_items(spark):
    rx = spark.createDataFrame([(1, "t", 10, 20, "Fever", "", None, dt.datetime(2024, 1, 2)),
                                (2, "t", 11, 20, "", "CBC", "Rest", dt.datetime(2024, 1, 3))],
                               "id long, tenant_id string, patient_id long, doctor_id long, problem string, "
                               "test string, advice string, created_at timestamp")
    pt = spark.createDataFrame([(10, "Ann", "Lee", "", "1990-01-01"), (11, "Bo", "Ng", "male", None)],
                               "id long, first_name string, last_name string, gender string, dob string")
    dr = spark.createDataFrame([(20, "Raju", "Boy", "")], "id long, first_name string, last_name string, specialist string")
    a = spark.createDataFrame([(1, 1, "Para", "", "", "night", "after food")],
                              "prescription_id long, line_no int, medicine_name string, dosage string, duration string, "
                              "time string, comment string")
    b = spark.createDataFrame([(1, 1, "Other", "5", "2 days", "am", ""), (2, 2, "Zinc", "1", "", "", "")],
                              "prescription_id long, line_no int, medicine_name string, dosage string, duration string, "
                              "time string, comment string")
    for method in ("aggregate", "window"):
        items = first_source([("prescription_medicines", a), ("prescription_items", b), ("absent", None)],
                             "prescription_id", method)
        got = sorted((r["prescription_id"], r["medicine_name"], r["source_table"]) for r in items.collect())
        assert got == [(1, "Para", "prescription_medicines"), (2, "Zinc", "prescription_items")]
    items = first_source([("prescription_medicines", a)], "prescription_id")
    bodies = {r["prescription_id"]: r["body"] for r in
              document_bodies(prescription_document_lines(rx, pt, dr, items)).collect()}
    b1 = bodies[1].split("\n")
    assert b1[1] == "Dr. Raju Boy" and b1[2] == "General Physician"
    assert "Gender: N/A | Date of Birth: 1990-01-01" in b1 and "DIAGNOSIS / CHIEF COMPLAINT" in b1
    assert "1. Para" in b1 and "   Dosage: As directed | Duration: N/A | Time: night" in b1
    assert "   Note: after food" in b1 and "ADVICE & TESTS" not in b1
    b2 = bodies[2].split("\n")
    assert "No medications listed." in b2 and "Tests: CBC" in b2 and "Advice: Rest" in b2
    assert "DIAGNOSIS / CHIEF COMPLAINT" not in b2 and "Gender: male | Date of Birth: N/A" in b2


def test_numbering_range_form_equals_window_form_on_a_hot_key(spark):
    from pyspark.sql import functions as F
    from wardlight.functions.numbering import number_within, number_within_range, number_within_window
    # one key holds most rows (the skew case), the rest are small groups
    df = spark.range(0, 5000).select(F.when(F.col("id") < 4000, F.lit(7)).otherwise(F.col("id") % 50).alias("k"),
                                     (F.col("id") * 7919 % 100003).alias("o"))
    want = {(r["k"], r["o"]): r["n"] for r in number_within_window(df, "k", ["o"]).collect()}
    got = {(r["k"], r["o"]): r["n"] for r in number_within_range(df, "k", ["o"], num_partitions=13).collect()}
    assert got == want
    adaptive = number_within(df, "k", ["o"], hot_group_rows=100)
    assert {(r["k"], r["o"]): r["n"] for r in adaptive.collect()} == want


def test_checkpoint_root_when_the_session_names_no_folder():
    from wardlight.session import checkpoint_root

    class Conf:
        def get(self, key, default=None):
            return default

    class Ctx:
        def __init__(self):
            self.dir = None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Sess:
        conf, sparkContext = Conf(), Ctx()

    s = Sess()
    root = checkpoint_root(s)
    assert root and s.sparkContext.dir == root and checkpoint_root(s) == root   # stable, no conf.set


def test_document_sink_per_tenant_and_table_listing(spark, tmpdir_path):
    import os
    from wardlight.operators.documents import write_documents
    from wardlight.sources.discovery import list_tables, register_views
    from wardlight.sources.tables import Catalog
    from wardlight.plans.queries_documents import q_prescription_documents
    lines = q_prescription_documents(spark, "/root/testdata/sf0.001")
    write_documents(lines, tmpdir_path + "/docs")
    tenants = sorted(d for d in os.listdir(tmpdir_path + "/docs") if d.startswith("tenant_id="))
    assert tenants == [f"tenant_id={t}" for t in "01234"]
    back = spark.read.parquet(tmpdir_path + "/docs")
    assert back.count() == lines.count()
    register_views({"wl_patients": Catalog(spark, "/root/testdata/sf0.001").patients()})
    assert "wl_patients" in {r["table_name"] for r in list_tables(spark).collect()}


def test_first_source_third_candidate_and_ties(spark):
    schema = "prescription_id long, line_no int, medicine_name string"
    a = spark.createDataFrame([(1, 1, "A1")], schema)
    b = spark.createDataFrame([(1, 1, "B1"), (2, 1, "B2")], schema)
    c = spark.createDataFrame([(1, 1, "C1"), (2, 1, "C2"), (3, 1, "C3"), (3, 2, "C3b")], schema)
    for method in ("aggregate", "window"):
        got = sorted((r["prescription_id"], r["medicine_name"], r["source_table"]) for r in
                     first_source([("t1", a), ("t2", b), ("t3", c), ("t4", None)], "prescription_id", method).collect())
        assert got == [(1, "A1", "t1"), (2, "B2", "t2"), (3, "C3", "t3"), (3, "C3b", "t3")], method
