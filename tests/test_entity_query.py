"""Q1 on hand-written clinical rows (FIXTURES §5 edge rows) and on the driver tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardlight.operators.entity_query import build_entity_query, entity_query, result_count
from wardlight.plans.intent import Intent
from wardlight.sources.mapping import EntityMapping, apply_mapping, parse_mapping
from wardlight.sources.tables import DRIVER_MAPPINGS, Catalog

AS_OF = dt.datetime(2024, 3, 15, 10, 0)

MAPPINGS = {
    "patients": EntityMapping("patients", "patients", {"id": "id", "tenant": "tenant_id",
                                                        "firstName": "first_name", "lastName": "last_name"}),
    "doctors": EntityMapping("doctors", "doctors", {"id": "id", "tenant": "tenant_id", "firstName": "first_name",
                                                     "lastName": "last_name", "experience": "experience",
                                                     "department": "doctor_department_id"}),
    "appointments": EntityMapping("appointments", "appointments", {
        "id": "id", "tenant": "tenant_id", "patient": "patient_id", "doctor": "doctor_id",
        "scheduledAt": "opd_date", "status": "status", "createdAt": "created_at"}),
}


@pytest.fixture(scope="module")
def tables(spark):
    patients = spark.createDataFrame([
        (1, "t1", "Ravi", "Kumar"), (2, "t1", None, "Sam"), (3, "t1", "sam", "O'Neil"),
        (4, "t1", "Anna_Maria", "50%Off"), (5, "t2", "Ravi", "Kumar"), (6, "t1", "RAVI", "kumar"),
    ], "id long, tenant_id string, first_name string, last_name string")
    doctors = spark.createDataFrame([
        (10, "t1", "Raju", "Boy", 12, "3"), (11, "t1", "Sarah", "Lee", 4, "5"), (12, "t2", "Raju", "Boy", 30, "3"),
    ], "id long, tenant_id string, first_name string, last_name string, experience int, doctor_department_id string")
    ts = lambda s: dt.datetime.fromisoformat(s)
    appts = spark.createDataFrame([
        (100, "t1", 1, 10, ts("2024-03-15 09:00:00"), 0, ts("2024-03-01 00:00:00")),
        (101, "t1", 2, 11, ts("2024-03-14 23:59:59"), 4, ts("2024-03-01 00:00:00")),
        (102, "t1", 3, 10, ts("2024-03-09 08:00:00"), 1, ts("2024-03-01 00:00:00")),
        (103, "t2", 5, 12, ts("2024-03-15 09:00:00"), 0, ts("2024-03-01 00:00:00")),
        (104, "t1", 6, 12, ts("2024-03-16 00:00:00"), 0, ts("2024-03-01 00:00:00")),
    ], "id long, tenant_id string, patient_id long, doctor_id long, opd_date timestamp_ntz, status int, "
       "created_at timestamp_ntz")
    return {"patients": patients, "doctors": doctors, "appointments": appts}


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_tenant_isolation_and_default_limit(tables):
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], limit=0), "t1", AS_OF)
    assert ids(q) == [1, 2, 3, 4, 6]                       # limit 0 → 5, t2 rows never
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], limit=2), "t1", AS_OF)
    assert ids(q) == [1, 2]
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], limit=1000), "t1", AS_OF)
    assert len(ids(q)) == 5
    q = entity_query(tables, MAPPINGS, Intent.of("list", []), "t1", AS_OF)   # default target
    assert ids(q) == [100, 101, 102, 104]


def test_names_case_insensitive_null_and_literal_wildcards(tables):
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], patientName="ravi kumar"), "t1", AS_OF)
    assert ids(q) == [1, 6]                                  # mixed case both match
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], patientName="sam"), "t1", AS_OF)
    assert ids(q) == [3]                                     # null first name → full name null
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], patientName="50%"), "t1", AS_OF)
    assert ids(q) == [4]                                     # % is literal by default
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], patientName="a_m"), "t1", AS_OF)
    assert ids(q) == [4]
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], patientName="a_m"), "t1", AS_OF,
                     wildcards=True)
    assert ids(q) == [4]
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], patientName="starts with RA"), "t1", AS_OF)
    assert ids(q) == [1, 6]
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], patientName="starts with  "), "t1", AS_OF)
    assert ids(q) == []                                      # empty remainder stays "contains"


def test_joins_status_dates_and_counts(tables):
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], doctorName="raju boy"), "t1", AS_OF)
    assert ids(q) == [100, 102, 104]                         # 104's doctor is a t2 doctor (reference parity)
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], doctorName="raju boy"), "t1", AS_OF,
                     strict_tenant=True)
    assert ids(q) == [100, 102]
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], patientName="ravi"), "t1", AS_OF)
    assert ids(q) == [100, 104]
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], status="Pending"), "t1", AS_OF)
    assert ids(q) == [100, 104]
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], status="cancelled"), "t1", AS_OF)
    assert ids(q) == [101]
    with pytest.raises(ValueError):
        entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], status="lost"), "t1", AS_OF)
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], date="today"), "t1", AS_OF)
    assert ids(q) == [100]
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], date="yesterday"), "t1", AS_OF)
    assert ids(q) == [101]
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], date="last week"), "t1", AS_OF)
    assert ids(q) == [102]                                   # Sun 3 Mar .. Sat 9 Mar
    eq = build_entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], date="on 2024-03-15"),
                            "t1", AS_OF)
    assert eq.warnings and ids(eq.df) == [100, 101, 102, 104]  # invalid date → no date filter
    agg = build_entity_query(tables, MAPPINGS, Intent.of("aggregate", ["appointments"]), "t1", AS_OF)
    assert agg.df.first()["count"] == 4
    assert result_count(agg).first()["results_count"] == 4
    lst = build_entity_query(tables, MAPPINGS, Intent.of("list", ["appointments"], limit=2), "t1", AS_OF)
    assert result_count(lst).first()["results_count"] == 2


def test_ignored_filters_and_unknown_target(tables):
    eq = build_entity_query(tables, MAPPINGS, Intent.of("list", ["patients"], department="x", doctorName="raju"),
                            "t1", AS_OF)
    assert set(eq.ignored_filters) == {"department", "doctorName"}
    with pytest.raises(ValueError):
        entity_query(tables, MAPPINGS, Intent.of("list", ["invoices"]), "t1", AS_OF)
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["doctors"], minExperience=12), "t1", AS_OF)
    assert ids(q) == [10]
    assert Intent.of("export_pdf", ["doctors", "prescriptions"]).target() == "prescriptions"
    assert Intent.of("lookup", ["doctors", "prescriptions"]).target() == "doctors"


def test_mapping_parse_drops_password_and_bom(spark):
    m = parse_mapping('﻿ {"u": {"table": "users", "id": "id", "password": "pw", "userPassword": "p2"}}')
    assert m["u"].columns == {"id": "id"}
    fallback = {"x": EntityMapping("x", "x", {"id": "id"})}
    assert parse_mapping("{not json", defaults=fallback) == fallback
    df = spark.createDataFrame([(1, "h")], "id long, pw string")
    assert apply_mapping(df, m["u"]).columns == ["id"]
    with pytest.raises(ValueError):
        apply_mapping(df, EntityMapping("y", "y", {"a": "missing"}))


def test_driver_binding_tenant_filter_pushes_and_prunes(spark):
    cat = Catalog(spark, "/root/testdata/sf0.001")
    df = entity_query(cat.tables(), DRIVER_MAPPINGS, Intent.of("list", ["appointments"], status="pending"),
                      "1", AS_OF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "o_orderpriority" in plan or "ReadSchema" in plan
    assert df.count() <= 5
    assert all(r["tenant_id"] == "1" for r in df.collect())
    assert F.col("id") is not None


def test_doctor_name_has_no_prefix_form(tables):
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["doctors"], doctorName="starts with ra"), "t1", AS_OF)
    assert ids(q) == []                       # contains "starts with ra" → nobody
    q = entity_query(tables, MAPPINGS, Intent.of("list", ["doctors"], doctorName="AJU B"), "t1", AS_OF)
    assert ids(q) == [10]


def test_tenant_layout_turns_the_tenant_filter_into_partition_pruning(spark, tmpdir_path):
    from wardlight.sources.tables import read_by_tenant, write_by_tenant
    cat = Catalog(spark, "/root/testdata/sf0.001")
    write_by_tenant(cat.appointments(), tmpdir_path + "/appointments")
    laid_out = read_by_tenant(spark, tmpdir_path + "/appointments")
    tables = {"appointments": laid_out}
    q = entity_query(tables, DRIVER_MAPPINGS, Intent.of("aggregate", ["appointments"]), "1", AS_OF)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "(tenant_id" in plan and "= 1)" in plan
    direct = entity_query(cat.tables(), DRIVER_MAPPINGS, Intent.of("aggregate", ["appointments"]), "1", AS_OF)
    assert q.first()["count"] == direct.first()["count"]
