"""Registered declared shapes (D1-D15), date keywords (X4-X7), mapping and discovery."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wardlight.functions.dates import resolve_date_columns
from wardlight.functions.text import name_contains
from wardlight.operators import shapes
from wardlight.operators.entity_query import entity_counts
from wardlight.plans.intent import Intent
from wardlight.plans.oracle_views import with_views
from wardlight.plans.registry import AS_OF, _eq, register
from wardlight.sources.mapping import apply_mapping, parse_mapping
from wardlight.sources.tables import DRIVER_MAPPINGS, Catalog

LAST_MONTH_SQL = "BETWEEN TIMESTAMP '1998-09-01 00:00:00' AND TIMESTAMP '1998-09-30 23:59:59.999'"


@register("either_name_match", with_views("patients") +
          """SELECT id, tenant_id, first_name, last_name FROM patients WHERE tenant_id = '2'
             AND (contains(lower(first_name), '0000007') OR contains(lower(last_name), '0000007'))""")
def q_either_name_match(spark, sf_dir):
    p = Catalog(spark, sf_dir).patients()
    return (shapes.tenant_rows(p, "2")
            .where(name_contains(F.col("first_name"), "0000007") | name_contains(F.col("last_name"), "0000007"))
            .select("id", "tenant_id", "first_name", "last_name"))


# date keywords: every order carries a keyword derived from its key and is resolved against its
# own date as "now" (exercises week / month / year borders across the whole table)
_KW_SPARK = """CASE pmod(o_orderkey, 9)
    WHEN 0 THEN 'today' WHEN 1 THEN 'Yesterday' WHEN 2 THEN 'last week' WHEN 3 THEN 'LAST month'
    WHEN 4 THEN 'tomorrow please' WHEN 5 THEN date_format(o_orderdate, 'yyyy-MM-dd')
    WHEN 6 THEN concat(cast(year(o_orderdate) AS string), '-02-', cast(28 + pmod(o_orderkey div 9, 4) AS string))
    WHEN 7 THEN concat('on ', date_format(o_orderdate, 'yyyy-MM-dd'))
    ELSE 'this month' END"""
_KW_DUCK = """CASE o_orderkey % 9
    WHEN 0 THEN 'today' WHEN 1 THEN 'Yesterday' WHEN 2 THEN 'last week' WHEN 3 THEN 'LAST month'
    WHEN 4 THEN 'tomorrow please' WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 6 THEN CAST(year(o_orderdate) AS VARCHAR) || '-02-' || CAST(28 + (o_orderkey // 9) % 4 AS VARCHAR)
    WHEN 7 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d')
    ELSE 'this month' END"""

_DATE_KW_SQL = f"""WITH kw AS (SELECT o_orderkey AS id, {_KW_DUCK} AS keyword, CAST(o_orderdate AS DATE) AS today
                     FROM orders),
r AS (SELECT id, keyword, today, lower(keyword) AS k,
        CAST(make_date(TRY_CAST(substr(keyword, 1, 4) AS INTEGER), 1, 1)
             + to_months(TRY_CAST(substr(keyword, 6, 2) AS INTEGER) - 1) AS DATE) AS iso_month
      FROM kw),
s AS (SELECT id, keyword,
  CASE WHEN contains(k, 'today') THEN today
       WHEN contains(k, 'yesterday') THEN today - 1
       WHEN contains(k, 'week') AND contains(k, 'last') THEN (today - 7) - CAST(dayofweek(today - 7) AS INTEGER)
       WHEN contains(k, 'month') AND contains(k, 'last') THEN CAST(date_trunc('month', today - INTERVAL 1 MONTH) AS DATE)
       WHEN contains(k, 'tomorrow') THEN today + 1
       WHEN regexp_matches(k, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN
            CASE WHEN regexp_matches(k, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
                 THEN iso_month + TRY_CAST(substr(keyword, 9, 2) AS INTEGER) - 1 END
       ELSE today END AS d0,
  CASE WHEN contains(k, 'today') THEN today + 1
       WHEN contains(k, 'yesterday') THEN today
       WHEN contains(k, 'week') AND contains(k, 'last') THEN (today - 7) - CAST(dayofweek(today - 7) AS INTEGER) + 7
       WHEN contains(k, 'month') AND contains(k, 'last') THEN CAST(date_trunc('month', today) AS DATE)
       WHEN contains(k, 'tomorrow') THEN today + 2
       WHEN regexp_matches(k, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN
            CASE WHEN regexp_matches(k, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
                 THEN iso_month + TRY_CAST(substr(keyword, 9, 2) AS INTEGER) END
       ELSE today + 1 END AS d1
  FROM r)
SELECT id, keyword, CAST(d0 AS TIMESTAMP) AS range_start,
       CAST(d1 AS TIMESTAMP) - INTERVAL 1 MILLISECOND AS range_end FROM s"""


@register("date_keywords", _DATE_KW_SQL)
def q_date_keywords(spark, sf_dir):
    o = Catalog(spark, sf_dir, spread=True).raw("orders")
    kw = o.select(F.col("o_orderkey").alias("id"), F.expr(_KW_SPARK).alias("keyword"), "o_orderdate")
    start, end = resolve_date_columns(F.col("keyword"), F.col("o_orderdate"))
    return kw.select("id", "keyword", start.alias("range_start"), end.alias("range_end"))


@register("min_experience", with_views("doctors") +
          "SELECT * FROM doctors WHERE tenant_id = '1' AND experience >= 10 ORDER BY id LIMIT 1000")
def q_min_experience(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("list", ["doctors"], minExperience=10, limit=1000), "1")


@register("revenue_month", with_views("appointments") +
          """SELECT tenant_id, round(sum(amount), 2) AS revenue, count(*) AS n FROM appointments
             WHERE opd_date BETWEEN TIMESTAMP '1998-10-01 00:00:00' AND TIMESTAMP '1998-10-31 23:59:59.999'
             GROUP BY tenant_id""")
def q_revenue_month(spark, sf_dir):
    return shapes.revenue_in_range(Catalog(spark, sf_dir).appointments(), "this month", AS_OF)


@register("top_doctor", with_views("appointments") +
          """SELECT tenant_id, doctor_id, n_appointments FROM (
               SELECT tenant_id, doctor_id, count(*) AS n_appointments,
                      row_number() OVER (PARTITION BY tenant_id ORDER BY count(*) DESC, doctor_id) AS rn
               FROM appointments GROUP BY tenant_id, doctor_id) WHERE rn = 1""")
def q_top_doctor(spark, sf_dir):
    return shapes.top_doctor(Catalog(spark, sf_dir).appointments())


@register("latest_per_patient", with_views("appointments") +
          """SELECT patient_id, id, opd_date FROM (
               SELECT patient_id, id, opd_date,
                      row_number() OVER (PARTITION BY patient_id ORDER BY opd_date DESC, id DESC) AS rn
               FROM appointments) WHERE rn = 1""")
def q_latest_per_patient(spark, sf_dir):
    return shapes.latest_per_key(Catalog(spark, sf_dir).appointments(), "patient_id", "opd_date")


@register("entity_counts", with_views("patients", "doctors", "appointments", "prescriptions") +
          """SELECT 'patients' AS entity, count(*) AS count FROM patients WHERE tenant_id = '1'
             UNION ALL SELECT 'doctors', count(*) FROM doctors WHERE tenant_id = '1'
             UNION ALL SELECT 'appointments', count(*) FROM appointments WHERE tenant_id = '1'
             UNION ALL SELECT 'prescriptions', count(*) FROM prescriptions WHERE tenant_id = '1'""")
def q_entity_counts(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    return entity_counts(cat.tables(), DRIVER_MAPPINGS,
                         ["patients", "doctors", "appointments", "prescriptions"], "1", AS_OF)


@register("last_n", with_views("appointments") +
          """SELECT * FROM appointments WHERE tenant_id = '2' ORDER BY opd_date DESC, id DESC LIMIT 5""")
def q_last_n(spark, sf_dir):
    a = Catalog(spark, sf_dir).appointments()
    return shapes.last_n(shapes.tenant_rows(a, "2"), "opd_date", 5)


@register("patients_seen", with_views("patients", "appointments") +
          f"""SELECT id, first_name, last_name FROM patients p WHERE tenant_id = '1' AND EXISTS (
                SELECT 1 FROM appointments a WHERE a.patient_id = p.id AND a.opd_date {LAST_MONTH_SQL})""")
def q_patients_seen(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    p = shapes.tenant_rows(cat.patients(), "1").select("id", "first_name", "last_name")
    return shapes.with_event_in_range(p, cat.appointments(), "id", "patient_id", "opd_date",
                                      "last month", AS_OF)


@register("doctors_absent", with_views("doctors", "holidays") +
          """SELECT id, tenant_id, first_name, last_name FROM doctors d WHERE EXISTS (
               SELECT 1 FROM holidays h WHERE h.doctor_id = d.id
               AND CAST(h.date AS TIMESTAMP) BETWEEN TIMESTAMP '1998-09-01 00:00:00'
                                            AND TIMESTAMP '1998-09-30 23:59:59.999')""")
def q_doctors_absent(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    d = cat.doctors().select("id", "tenant_id", "first_name", "last_name")
    h = cat.holidays().withColumn("day_ts", F.col("date").cast("timestamp_ntz"))
    return shapes.with_event_in_range(d, h, "id", "doctor_id", "day_ts", "last month", AS_OF)


@register("doctors_available", with_views("doctors", "holidays") +
          """SELECT id, tenant_id, first_name, last_name FROM doctors d WHERE NOT EXISTS (
               SELECT 1 FROM holidays h WHERE h.doctor_id = d.id
               AND CAST(h.date AS TIMESTAMP) BETWEEN TIMESTAMP '1998-09-01 00:00:00'
                                            AND TIMESTAMP '1998-09-30 23:59:59.999')""")
def q_doctors_available(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    d = cat.doctors().select("id", "tenant_id", "first_name", "last_name")
    h = cat.holidays().withColumn("day_ts", F.col("date").cast("timestamp_ntz"))
    return shapes.without_event_in_range(d, h, "id", "doctor_id", "day_ts", "last month", AS_OF)


@register("distinct_patients", with_views("appointments") +
          "SELECT doctor_id, count(DISTINCT patient_id) AS patients FROM appointments GROUP BY doctor_id")
def q_distinct_patients(spark, sf_dir):
    return shapes.distinct_per_key(Catalog(spark, sf_dir).appointments(), "doctor_id", "patient_id",
                                   "patients")


@register("flagged_patients", with_views("patients", "prescriptions") +
          """SELECT id, first_name, last_name FROM patients p WHERE tenant_id = '3' AND EXISTS (
               SELECT 1 FROM prescriptions r WHERE r.patient_id = p.id AND r.diabetic = 1)""")
def q_flagged_patients(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    p = shapes.tenant_rows(cat.patients(), "3").select("id", "first_name", "last_name")
    return shapes.flagged(p, cat.prescriptions(), "id", "patient_id", "diabetic")


@register("senior_doctor", with_views("doctors") +
          """SELECT tenant_id, id, experience FROM (
               SELECT tenant_id, id, experience,
                      row_number() OVER (PARTITION BY tenant_id ORDER BY experience DESC, id) AS rn
               FROM doctors) WHERE rn = 1""")
def q_senior_doctor(spark, sf_dir):
    return shapes.most_senior(Catalog(spark, sf_dir).doctors())


@register("at_time", with_views("appointments") +
          """SELECT id, tenant_id, opd_date FROM appointments
             WHERE opd_date >= TIMESTAMP '1998-10-03 00:00:00' AND opd_date < TIMESTAMP '1998-10-03 00:01:00'""")
def q_at_time(spark, sf_dir):
    a = Catalog(spark, sf_dir).appointments()
    return shapes.at_minute(a, "opd_date", dt.datetime(1998, 10, 3, 0, 0, 30)).select("id", "tenant_id", "opd_date")


# S3: a JSON mapping (with a password key, which is dropped) applied to a raw table
_CUSTOMER_MAPPING = """{"customers": {"table": "customer", "id": "c_custkey", "name": "c_name",
  "nation": "c_nationkey", "password": "c_acctbal", "segment": "c_mktsegment"}}"""


@register("mapped_projection",
          "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def q_mapped_projection(spark, sf_dir):
    m = parse_mapping(_CUSTOMER_MAPPING)["customers"]
    return apply_mapping(Catalog(spark, sf_dir).raw(m.table), m)
