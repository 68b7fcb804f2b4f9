"""Batched answers against single intents, rare-trigram matching, tenants through a parent, department words."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from wardlight.operators.answers import answer_questions, answer_records
from wardlight.operators.entity_query import build_entity_query, entity_query
from wardlight.operators.name_match import containing
from wardlight.plans.intent import Intent
from wardlight.sources.mapping import EntityMapping, parse_mapping

AS_OF = dt.datetime(2024, 3, 13, 10, 0)
QUESTION = ("question_id long, tenant_id string, operation string, target string, doctorName string, patientName string, "
            "department string, status string, date string, minExperience double, limit double")
MAPPINGS = {
    "patients": EntityMapping("patients", "patients", {"id": "id", "tenant": "tenant_id", "firstName": "first", "lastName": "last"}),
    "doctors": EntityMapping("doctors", "doctors", {"id": "id", "tenant": "tenant_id", "firstName": "first", "lastName": "last",
                                                    "experience": "years", "department": "dept_id"},
                             lookups={"department": ("departments", "id", "title")}),
    "appointments": EntityMapping("appointments", "appointments", {
        "id": "id", "tenant": "tenant_id", "patient": "patient_id", "doctor": "doctor_id", "status": "status",
        "department": "dept_id", "scheduledAt": "at"}, lookups={"department": ("departments", "id", "title")}),
    "dependents": EntityMapping("dependents", "dependents", {"id": "id", "patient": "patient_id"}),
    "schedules": EntityMapping("schedules", "schedules", {"id": "id", "doctor": "doctor_id"}),
    "scheduleDays": EntityMapping("scheduleDays", "schedule_days", {"id": "id", "schedule": "schedule_id"}),
    "notes": EntityMapping("notes", "notes", {"id": "id"}),
}


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(1)
    names = ["Ann", "Anna", "Bo", None, "Ravi", "Li", "İpek", "100%", "a_b", "Hannah"]

    def people(n, *more):
        return [(i, f"t{i % 2}" if i % 7 else None, rnd.choice(names), rnd.choice(names), *[m(i) for m in more]) for i in range(n)]
    last = [dt.datetime(2024, 3, 12, 23, 59, 59, u) for u in (998_000, 999_000, 999_500)]
    visits = [(i, f"t{rnd.randrange(2)}", rnd.randrange(30), rnd.randrange(12), rnd.choice([0, 1, 4, None]), rnd.choice([1, 2, 3, None]),
               rnd.choice([dt.datetime(2024, 3, 1) + dt.timedelta(hours=rnd.randrange(400)), None, *last])) for i in range(200)]
    make = spark.createDataFrame
    return {
        "patients": make(people(28), "id long, tenant_id string, first string, last string"),
        "doctors": make(people(12, lambda i: i % 5 if i else None, lambda i: i % 4), "id long, tenant_id string, first string, last string, years int, dept_id int"),
        "appointments": make(visits, "id long, tenant_id string, patient_id long, doctor_id long, status int, dept_id int, at timestamp_ntz"),
        "dependents": make([(i, i % 35) for i in range(50)], "id long, patient_id long"),
        "schedules": make([(i, i % 14) for i in range(20)], "id long, doctor_id long"),
        "schedule_days": make([], "id long"), "scheduleDays": make([(i, i % 25) for i in range(60)], "id long, schedule_id long"),
        "departments": make([(1, "Cardiology"), (2, "Neurology"), (3, "Paediatric cardiology"), (4, None)], "id int, title string"),
        "notes": make([(1,)], "id long"),
    }


def questions():
    rnd = random.Random(5)
    out = [(0, "t0", "aggregate", None, None, None, None, None, None, None, None), (1, "t1", "list", "", None, None, None, None, None, None, 0.0),
           (2, "t0", "list", "rooms", None, None, None, None, None, None, 3.0), (3, "t0", "list", "appointments", None, None, None, "odd", None, None, 3.0),
           (4, "t0", "aggregate", "doctors", None, None, "cardiology", None, None, 2.0, float("nan")),
           (5, "t0", "list", "appointments", None, None, "CARDIO", " Pending", "last month", None, 50.0),
           (6, "t0", "list", "patients", "x", "starts with ann", None, "pending", "today", 1.0, 50.0), (7, None, "list", "patients", None, None, None, None, None, None, 5.0),
           (8, "t1", "aggregate", "appointments", "an", "Starts With ", None, None, None, None, None)]
    for i in range(9, 40):
        out.append((i, rnd.choice(["t0", "t1"]), rnd.choice(["aggregate", "list", "lookup"]), rnd.choice(["appointments"] * 3 + ["doctors", "patients", "dependents"]),
                    rnd.choice([None, None, "a", "an", "ann bo", "%", "_", "zz"]), rnd.choice([None, None, "ANN", "starts with anna l", "i̇pek", "n", "100%"]),
                    rnd.choice([None, None, None, "2", "neuro", "none such"]), rnd.choice([None, None, "completed", "1", "cancelled"]),
                    rnd.choice([None, None, "yesterday", "2024-03-12", "last week", "on 2024-03-12", "tomorrow"]), rnd.choice([None, None, 1.0, 3.0]),
                    rnd.choice([None, 1.0, 4.0, 60.0])))
    return out


def test_batch_equals_single_intents(spark, tables):
    asked = questions()
    got = {r["question_id"]: r for r in answer_questions(tables, MAPPINGS, spark.createDataFrame(asked, QUESTION).repartition(3), AS_OF).collect()}
    assert set(got) == {q[0] for q in asked}
    for q in asked:
        g, names = got[q[0]], ["doctorName", "patientName", "department", "status", "date", "minExperience", "limit"]
        intent = Intent.of(q[2], [q[3]] if q[3] else [], **dict(zip(names, q[4:])))
        if q[1] is None:
            assert g["record_ids"] == []
            continue
        try:
            one = build_entity_query(tables, MAPPINGS, intent, q[1], AS_OF)
        except ValueError as e:
            assert g["error"] == str(e).replace("'", "") and g["results_count"] is None and g["record_ids"] is None
            continue
        assert g["error"] is None and g["ignored_filters"] == ",".join(f for f in names if f in one.ignored_filters), q
        if one.aggregate:
            assert g["record_ids"] is None and g["results_count"] == one.df.first()["count"], q
        else:
            ids = [str(r["id"]) for r in one.df.collect()]
            assert g["record_ids"] == ids and g["results_count"] == len(ids), q
    answers = answer_questions(tables, MAPPINGS, spark.createDataFrame([asked[1], asked[1]], QUESTION), AS_OF)
    rows = answer_records(tables, MAPPINGS, answers, "appointments").collect()
    assert len(rows) == 10 and {r["rank"] for r in rows} == {1, 2, 3, 4, 5} and all(r["tenant_id"] == "t1" for r in rows)
    assert answer_questions(tables, MAPPINGS, spark.createDataFrame([], QUESTION), AS_OF).count() == 0


def test_containing_equals_a_scan(spark):
    rnd = random.Random(2)
    names = [("s" if rnd.random() < 0.7 else "t", "".join(rnd.choice("abc é") for _ in range(rnd.randrange(9))), i) for i in range(150)]
    names += [("s", None, 900), ("s", "abcabc", 901), ("s", "abcabc", 902)]
    needles = [(rnd.choice("st"), "".join(rnd.choice("abc é") for _ in range(rnd.randrange(6)))) for _ in range(80)] + [("s", None), ("s", "abc"), ("s", "abc"), ("s", "zzzz"), ("u", "a")]
    got = containing(spark.createDataFrame(needles, "scope string, needle string"), spark.createDataFrame(names, "scope string, name string, id long"))
    want = {(s, x, i) for s, x in needles if x for t, n, i in names if s == t and n and x in n}
    rows = [(r["scope"], r["needle"], r["id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_tenant_comes_from_the_parent(spark, tables):
    patients = {r["id"] for r in tables["patients"].where("tenant_id = 't0'").collect()}
    doctors = {r["id"] for r in tables["doctors"].where("tenant_id = 't0'").collect()}
    got = entity_query(tables, MAPPINGS, Intent.of("list", ["dependents"], limit=100), "t0", AS_OF).collect()
    assert [r["id"] for r in got] == [i for i in range(50) if i % 35 in patients]
    days = entity_query(tables, MAPPINGS, Intent.of("list", ["scheduleDays"], limit=100), "t0", AS_OF).collect()      # day -> schedule -> doctor
    assert [r["id"] for r in days] == [i for i in range(60) if i % 25 < 20 and (i % 25) % 14 in doctors] and days[0].asDict().keys() == {"id", "schedule_id"}
    with pytest.raises(ValueError):
        entity_query(tables, MAPPINGS, Intent.of("list", ["notes"]), "t0", AS_OF)


def test_department_words(spark, tables):
    count = lambda word: entity_query(tables, MAPPINGS, Intent.of("aggregate", ["appointments"], department=word), "t0", AS_OF).first()["count"]
    own = tables["appointments"].where("tenant_id = 't0'")
    assert count("cardiology") == own.where("dept_id in (1, 3)").count() > 0
    assert count("2") == count("NEURO") == own.where("dept_id = 2").count() and count("dentist") == 0
    m = parse_mapping('{"a": {"table": "t", "id": "id", "dept": "d", "tenantVia": {"key": "patient", "entity": "patients"}, '
                      '"lookups": {"department": {"entity": "departments", "id": "id", "name": "title"}}}}')["a"]
    assert m.tenant_via == ("patient", "patients") and m.lookups == {"department": ("departments", "id", "title")} and m.columns == {"id": "id", "dept": "d"}


def test_parent_semi_join_keeps_pruning(spark, tables):
    plan = entity_query(tables, MAPPINGS, Intent.of("aggregate", ["dependents"]), "t0", AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
