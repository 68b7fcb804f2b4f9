"""Named queries: each is a Spark job over the whole driver tables plus, where SQL can say the
same thing, its DuckDB oracle text. ``__spark_entry__`` exposes both dictionaries.

Every query reads the given tables (or frames Spark derives from them), so its work grows with the
scale factor. Limits appear only where the limit is the feature (``LIMIT n`` of an entity list,
top-k search, "last n").
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.plans.intent import Intent
from wardlight.plans.oracle_views import with_views
from wardlight.sources.tables import DRIVER_MAPPINGS, Catalog

# Fixed "now" of every registered query so results are reproducible.
AS_OF = dt.datetime(1998, 10, 3, 9, 30, 0)
AS_OF_SQL = "TIMESTAMP '1998-10-03 09:30:00'"

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _eq(spark: SparkSession, sf_dir: str, intent: Intent, tenant: str) -> DataFrame:
    from wardlight.operators.entity_query import entity_query
    cat = Catalog(spark, sf_dir)
    return entity_query(cat.tables(), DRIVER_MAPPINGS, intent, tenant, AS_OF)


# ---------------------------------------------------------------------------------------------
# Q1 family: tenant filter, name filters, status / department / date, joins, count, limit
# ---------------------------------------------------------------------------------------------

@register("count_appointments", with_views("appointments") +
          "SELECT count(*) AS count FROM appointments WHERE tenant_id = '1'")
def q_count_appointments(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("aggregate", ["appointments"]), "1")


@register("list_patients_limit", with_views("patients") +
          "SELECT * FROM patients WHERE tenant_id = '2' ORDER BY id LIMIT 20")
def q_list_patients_limit(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("list", ["patients"], limit=20), "2")


@register("default_limit", with_views("appointments") +
          "SELECT * FROM appointments WHERE tenant_id = '3' ORDER BY id LIMIT 5")
def q_default_limit(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("list", ["appointments"], limit=0), "3")


@register("patients_name_contains", with_views("patients") +
          """SELECT * FROM patients WHERE tenant_id = '2'
             AND contains(lower(first_name || ' ' || last_name), 'customer 00000012')
             ORDER BY id LIMIT 100""")
def q_patients_name_contains(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("list", ["patients"], patientName="CUSTOMER 00000012",
                                        limit=100), "2")


@register("patients_name_prefix", with_views("patients") +
          """SELECT * FROM patients WHERE tenant_id = '4'
             AND starts_with(lower(first_name || ' ' || last_name), 'customer 0000001')
             ORDER BY id LIMIT 50""")
def q_patients_name_prefix(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("list", ["patients"], patientName="Starts with Customer 0000001",
                                        limit=50), "4")


@register("appointments_by_status", with_views("appointments") +
          "SELECT * FROM appointments WHERE tenant_id = '1' AND status = 4 ORDER BY id LIMIT 100")
def q_appointments_by_status(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("list", ["appointments"], status="Cancelled", limit=100), "1")


@register("by_department", with_views("appointments") +
          """SELECT count(*) AS count FROM appointments
             WHERE tenant_id = '0' AND department_id = '1-URGENT'""")
def q_by_department(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("aggregate", ["appointments"], department="1-URGENT"), "0")


@register("by_date_range", with_views("appointments") +
          """SELECT * FROM appointments WHERE tenant_id = '0'
             AND opd_date BETWEEN TIMESTAMP '1998-09-01 00:00:00' AND TIMESTAMP '1998-09-30 23:59:59.999'
             ORDER BY id LIMIT 1000""")
def q_by_date_range(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("list", ["appointments"], date="last month", limit=1000), "0")


@register("appointments_by_patient", with_views("appointments", "patients") +
          """SELECT a.* FROM appointments a JOIN patients p ON p.id = a.patient_id
             WHERE a.tenant_id = '0' AND contains(lower(p.first_name || ' ' || p.last_name), 'customer 00000010')
             ORDER BY a.id LIMIT 100""")
def q_appointments_by_patient(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("list", ["appointments"], patientName="customer 00000010",
                                        limit=100), "0")


@register("appointments_by_doctor", with_views("appointments", "doctors") +
          """SELECT count(*) AS count FROM appointments a WHERE a.tenant_id = '3'
             AND EXISTS (SELECT 1 FROM doctors d WHERE d.id = a.doctor_id
                         AND contains(lower(d.first_name || ' ' || d.last_name), 'supplier 000000003'))""")
def q_appointments_by_doctor(spark, sf_dir):
    return _eq(spark, sf_dir, Intent.of("aggregate", ["appointments"], doctorName="Supplier 000000003"), "3")


@register("results_count", with_views("appointments") +
          """SELECT 'list' AS operation, count(*) AS results_count FROM (
               SELECT * FROM appointments WHERE tenant_id = '4' AND status = 0 ORDER BY id LIMIT 7)
             UNION ALL
             SELECT 'aggregate', count(*) FROM appointments WHERE tenant_id = '4' AND status = 0""")
def q_results_count(spark, sf_dir):
    """A2: the reported result count — rows returned (after the limit) for a list, the value of
    ``count`` for an aggregate — for the same filters."""
    from wardlight.operators.entity_query import build_entity_query, result_count
    cat = Catalog(spark, sf_dir)
    out = None
    for op in ("list", "aggregate"):
        q = build_entity_query(cat.tables(), DRIVER_MAPPINGS,
                               Intent.of(op, ["appointments"], status="pending", limit=7), "4", AS_OF)
        part = result_count(q).select(F.lit(op).alias("operation"), "results_count")
        out = part if out is None else out.unionByName(part)
    return out
