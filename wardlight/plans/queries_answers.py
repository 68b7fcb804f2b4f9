"""Registered queries of batched question answering, tenants through a parent and department words.

The questions are derived from the customers: one per customer, whose filters, targets and limits follow
from its key. The oracle joins questions with rows and tests every predicate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators.answers import answer_questions, answer_records
from wardlight.plans.intent import Intent
from wardlight.plans.oracle_views import with_views
from wardlight.plans.registry import AS_OF, _eq, register
from wardlight.sources.tables import DRIVER_MAPPINGS, Catalog

# Question columns over the customer key k; the text is the same in Spark and DuckDB.
_QUESTION = {
    "tenant_id": "CAST(k % 5 AS STRING)",
    "operation": "CASE k % 3 WHEN 0 THEN 'aggregate' WHEN 1 THEN 'list' ELSE 'lookup' END",
    "target": "CASE WHEN k % 97 = 0 THEN 'invoices' WHEN k % 6 = 2 THEN 'patients' WHEN k % 6 = 3 THEN 'doctors' "
              "WHEN k % 6 = 4 THEN 'prescriptions' WHEN k % 6 <> 5 THEN 'appointments' END",
    "doctorName": "CASE WHEN k % 4 = 1 THEN lpad(CAST(k % 100 AS STRING), 9, '0') WHEN k % 28 = 3 THEN 'SUPPLIER' END",
    "patientName": "CASE WHEN k % 5 = 2 THEN substring(lpad(CAST(k AS STRING), 9, '0'), 1, 8) "
                   "WHEN k % 35 = 4 THEN concat('Starts with CUSTOMER 0000000', CAST(k % 10 AS STRING)) WHEN k % 41 = 0 THEN '' END",
    "department": "CASE WHEN k % 7 = 3 THEN '1-URGENT' WHEN k % 7 = 5 THEN concat('Nation_', CAST(k % 25 AS STRING)) WHEN k % 42 = 15 THEN '7' END",
    "status": "CASE WHEN k % 4 = 2 THEN CASE k % 5 WHEN 0 THEN 'pending' WHEN 1 THEN ' Completed' WHEN 2 THEN '4' ELSE 'cancelled' END "
              "WHEN k % 53 = 0 THEN 'odd' WHEN k % 11 = 0 THEN 'F' END",
    "date": "CASE WHEN k % 9 = 4 THEN 'last month' WHEN k % 9 = 7 THEN concat('1997-0', CAST(1 + k % 8 AS STRING), '-15') "
            "WHEN k % 9 = 8 THEN 'some day, 1997-01-01' WHEN k % 45 = 0 THEN 'Yesterday' END",
    "minExperience": "CASE WHEN k % 6 = 3 AND k % 4 <> 1 THEN k % 20 END",
    "limit": "CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 12 ELSE 3 END",
}


def question_table(cat: Catalog):
    keys = cat.raw("customer").select(F.col("c_custkey").alias("k"))
    return keys.select(F.col("k").alias("question_id"), *[F.expr(text).alias(name) for name, text in _QUESTION.items()])


_ANSWERS_SQL = with_views("patients", "doctors", "appointments", "prescriptions") + """,
ask AS (SELECT k AS question_id, """ + ", ".join(f'{text} AS "{name}"' for name, text in _QUESTION.items()) + """
        FROM (SELECT c_custkey AS k FROM customer)),
q AS (SELECT question_id, tenant_id, operation, coalesce(target, 'appointments') AS target, operation = 'aggregate' AS counted,
        nullif(lower("doctorName"), '') AS dn, nullif(lower("patientName"), '') AS pn,
        CASE WHEN starts_with(lower("patientName"), 'starts with ') THEN trim(substring(lower("patientName"), 13)) END AS pre,
        department, status, "date", "minExperience" AS least,
        CASE lower(trim(status)) WHEN 'pending' THEN 0 WHEN 'completed' THEN 1 WHEN 'cancelled' THEN 4 WHEN '4' THEN 4 END AS code,
        CASE WHEN "limit" IS NULL OR "limit" = 0 THEN 5 ELSE "limit" END AS top,
        CASE WHEN "date" = 'last month' THEN DATE '1998-09-01' WHEN "date" = 'Yesterday' THEN DATE '1998-10-02'
             ELSE try_cast("date" AS DATE) END AS d0,
        CASE WHEN "date" = 'last month' THEN DATE '1998-10-01' WHEN "date" = 'Yesterday' THEN DATE '1998-10-03'
             ELSE try_cast("date" AS DATE) + 1 END AS d1 FROM ask),
pd AS (SELECT *, lower(first_name || ' ' || last_name) AS name FROM patients),
dd AS (SELECT d.*, lower(first_name || ' ' || last_name) AS name, lower(n_name) AS dept, doctor_department_id AS dept_id
       FROM doctors d LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = doctor_department_id),
visits AS (SELECT a.*, pd.name AS pname, dd.name AS dname FROM appointments a LEFT JOIN pd ON pd.id = patient_id LEFT JOIN dd ON dd.id = doctor_id),
rx AS (SELECT a.*, pd.name AS pname, dd.name AS dname FROM prescriptions a LEFT JOIN pd ON pd.id = patient_id LEFT JOIN dd ON dd.id = doctor_id),
hits AS (
  SELECT question_id, id FROM q JOIN visits r ON r.tenant_id = q.tenant_id AND q.target = 'appointments'
   AND (dn IS NULL OR contains(dname, dn)) AND (pn IS NULL OR CASE WHEN pre <> '' THEN starts_with(pname, pre) ELSE contains(pname, pn) END)
   AND (q.status IS NULL OR r.status = code) AND (department IS NULL OR department_id = department)
   AND (d0 IS NULL OR opd_date BETWEEN d0 AND CAST(d1 AS TIMESTAMP) - INTERVAL 1 MILLISECOND)
  UNION ALL SELECT question_id, id FROM q JOIN rx r ON r.tenant_id = q.tenant_id AND q.target = 'prescriptions'
   AND (dn IS NULL OR contains(dname, dn)) AND (pn IS NULL OR CASE WHEN pre <> '' THEN starts_with(pname, pre) ELSE contains(pname, pn) END)
   AND (q.status IS NULL OR r.status = q.status)
   AND (d0 IS NULL OR created_at BETWEEN d0 AND CAST(d1 AS TIMESTAMP) - INTERVAL 1 MILLISECOND)
  UNION ALL SELECT question_id, id FROM q JOIN pd r ON r.tenant_id = q.tenant_id AND q.target = 'patients'
   AND (pn IS NULL OR CASE WHEN pre <> '' THEN starts_with(r.name, pre) ELSE contains(r.name, pn) END) AND (department IS NULL OR segment = department)
  UNION ALL SELECT question_id, id FROM q JOIN dd r ON r.tenant_id = q.tenant_id AND q.target = 'doctors'
   AND (dn IS NULL OR contains(r.name, dn)) AND (department IS NULL OR contains(r.dept, lower(department)) OR r.dept_id = department)
   AND (least IS NULL OR experience >= least)),
ranked AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY id) AS rn FROM hits),
found AS (SELECT question_id, count(*) AS n FROM hits GROUP BY question_id),
flagged AS (SELECT *,
    CASE WHEN target = 'invoices' THEN 'Unsupported target entity: invoices'
         WHEN target = 'appointments' AND status IS NOT NULL AND code IS NULL THEN 'unknown status word for appointments: ' || status END AS error,
    CASE target WHEN 'appointments' THEN CASE WHEN least IS NOT NULL THEN 'minExperience' ELSE '' END
      WHEN 'prescriptions' THEN array_to_string(list_filter([CASE WHEN department IS NOT NULL THEN 'department' END,
          CASE WHEN least IS NOT NULL THEN 'minExperience' END], lambda x: x IS NOT NULL), ',')
      WHEN 'patients' THEN array_to_string(list_filter([CASE WHEN dn IS NOT NULL THEN 'doctorName' END, CASE WHEN status IS NOT NULL THEN 'status' END,
          CASE WHEN d0 IS NOT NULL THEN 'date' END, CASE WHEN least IS NOT NULL THEN 'minExperience' END], lambda x: x IS NOT NULL), ',')
      WHEN 'doctors' THEN array_to_string(list_filter([CASE WHEN pn IS NOT NULL THEN 'patientName' END, CASE WHEN status IS NOT NULL THEN 'status' END,
          CASE WHEN d0 IS NOT NULL THEN 'date' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS ignored_filters FROM q)
"""


@register("answer_questions", _ANSWERS_SQL + """
SELECT f.question_id, target, operation, ignored_filters, error,
       CASE WHEN error IS NOT NULL THEN NULL WHEN counted THEN coalesce(n, 0) ELSE least(coalesce(n, 0), top) END AS results_count,
       CASE WHEN error IS NULL AND NOT counted THEN coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) FROM ranked r
            WHERE r.question_id = f.question_id AND rn <= f.top), '') END AS record_ids
FROM flagged f LEFT JOIN found USING (question_id)""")
def q_answer_questions(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    mappings = {n: DRIVER_MAPPINGS[n] for n in ("patients", "doctors", "appointments", "prescriptions")}
    answers = answer_questions(cat.tables(), mappings, question_table(cat), AS_OF)
    return answers.withColumn("record_ids", F.array_join("record_ids", ","))


@register("answer_records", _ANSWERS_SQL + """
SELECT f.question_id, CAST(rn AS INTEGER) AS rank, a.* FROM flagged f JOIN ranked r ON r.question_id = f.question_id AND rn <= top
JOIN appointments a ON a.id = r.id WHERE target = 'appointments' AND NOT counted AND error IS NULL""")
def q_answer_records(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    answers = answer_questions(cat.tables(), {n: DRIVER_MAPPINGS[n] for n in ("appointments",)} | {n: DRIVER_MAPPINGS[n] for n in ("doctors", "patients")},
                               question_table(cat).where("coalesce(target, 'appointments') = 'appointments'"), AS_OF)
    return answer_records(cat.tables(), DRIVER_MAPPINGS, answers, "appointments")


@register("dependents_of_tenant", with_views("patients") +
          """SELECT event_id AS id, user_id AS patient_id, event_type AS relation, ts AS created_at FROM events
             WHERE user_id IN (SELECT id FROM patients WHERE tenant_id = '1') ORDER BY event_id LIMIT 200""")
def q_dependents_of_tenant(spark, sf_dir):
    """An entity without a tenant column: its patient's tenant decides."""
    return _eq(spark, sf_dir, Intent.of("list", ["dependents"], limit=200), "1")


@register("schedule_days_of_tenant", "SELECT count(*) AS count FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 2)")
def q_schedule_days_of_tenant(spark, sf_dir):
    """The tenant of a schedule's days is the schedule's."""
    return _eq(spark, sf_dir, Intent.of("aggregate", ["scheduleDays"]), "2")


@register("doctors_of_department", with_views("doctors") +
          """SELECT * FROM doctors WHERE tenant_id = '3' AND doctor_department_id IN
             (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE contains(lower(n_name), 'nation_1')) ORDER BY id LIMIT 50""")
def q_doctors_of_department(spark, sf_dir):
    """A department by a word of its name, through the table its id points to."""
    return _eq(spark, sf_dir, Intent.of("list", ["doctors"], department="NATION_1", limit=50), "3")
