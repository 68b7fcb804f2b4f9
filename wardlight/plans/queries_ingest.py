"""Registered ingest-family queries: passages (I1), stable ids (X10), upsert (S9), high-water (A3),
incremental batch (I3/S6/S7). The oracle text of the passage rule is generated from the same
mapping, mirroring ``wardlight.operators.passages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators.ingest import changed_rows, hashing_embedder, high_water, point_store, \
    run_incremental_ingest, upsert
from wardlight.operators.passages import build_passages
from wardlight.operators.vectors import search_store
from wardlight.plans.oracle_views import with_views
from wardlight.plans.registry import register
from wardlight.session import scratch_path
from wardlight.sources.mapping import EntityMapping
from wardlight.sources.tables import DRIVER_MAPPINGS, Catalog

# value kinds of the physical columns (for the oracle's String(value) rendering)
_KINDS = {
    "appointments": {"id": "int", "tenant_id": "str", "patient_id": "int", "doctor_id": "int",
                     "department_id": "str", "opd_date": "ts", "status": "int", "amount": "dbl",
                     "created_at": "ts", "updated_at": "ts"},
    "patients": {"id": "int", "tenant_id": "str", "first_name": "str", "last_name": "str",
                 "gender": "str", "dob": "str", "segment": "str", "nation_id": "int", "balance": "dbl"},
    "doctors": {"id": "int", "tenant_id": "str", "first_name": "str", "last_name": "str",
                "experience": "int", "doctor_department_id": "str", "specialist": "str"},
    "prescriptions": {"id": "int", "tenant_id": "str", "patient_id": "int", "doctor_id": "int",
                      "status": "str", "problem": "str", "test": "str", "advice": "str",
                      "diabetic": "int", "created_at": "ts", "updated_at": "ts"},
}


def _duck_string(col: str, kind: str) -> str:
    if kind == "str":
        return col
    if kind == "dbl":
        return (f"CASE WHEN {col} = floor({col}) THEN CAST(CAST(floor({col}) AS BIGINT) AS VARCHAR) "
                f"ELSE CAST({col} AS VARCHAR) END")
    if kind == "ts":
        return f"(strftime({col}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z')"
    return f"CAST({col} AS VARCHAR)"


def _duck_clean(alias: str, col: str, kind: str) -> str | None:
    a = alias.lower()
    if any(p in a for p in ("token", "path", "url", "password")):
        return None
    t = f"regexp_replace({_duck_string(col, kind)}, '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN {t} IS NULL OR length({t}) > 500 OR regexp_matches({t}, '^[a-fA-F0-9]{{32,}}$') "
            f"OR contains({t}, 'data:image') OR {t} = '' THEN NULL ELSE {t} END")


def passages_sql(source: str, entity: str, mapping: EntityMapping) -> str:
    """DuckDB SELECT producing the passage rows of ``source`` (a relation with physical columns)."""
    kinds = _KINDS[entity]
    parts, titles = [], []
    for alias, phys in mapping.columns.items():
        c = _duck_clean(alias, phys, kinds[phys])
        if c is None:
            continue
        parts.append(f"'{alias}: ' || ({c})")
        if "title" in alias.lower() or "name" in alias.lower():
            titles.append(f"({c})")
    text = f"substring(concat_ws(', ', {', '.join(parts)}), 1, 2000)"
    title = f"coalesce({', '.join(reversed(titles))}, substring({text}, 1, 100))" if titles \
        else f"substring({text}, 1, 100)"
    tenant = "coalesce(nullif(tenant_id, ''), 'default')"
    pid = "CASE WHEN patient_id <> 0 THEN patient_id END" if "patient_id" in kinds \
        else "CAST(NULL AS BIGINT)"
    upd = "updated_at" if "updated_at" in kinds else "CAST(NULL AS TIMESTAMP)"
    sid = (f"regexp_replace(md5('{mapping.table}' || ':' || {tenant} || ':' || CAST(id AS VARCHAR)), "
           f"'^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')")
    return (f"SELECT {sid} AS id, {tenant} AS tenant_id, '{mapping.table}' AS table_name, "
            f"CAST(id AS VARCHAR) AS record_id, {pid} AS patient_id, {title} AS title, {text} AS text, "
            f"{upd} AS updated_at FROM {source}")


def _passages(cat: Catalog) -> DataFrame:
    a = build_passages(cat.appointments(), DRIVER_MAPPINGS["appointments"])
    p = build_passages(cat.patients(), DRIVER_MAPPINGS["patients"])
    d = build_passages(cat.doctors(), DRIVER_MAPPINGS["doctors"])
    return a.unionByName(p).unionByName(d)


@register("passages", with_views("appointments", "patients", "doctors") +
          passages_sql("appointments", "appointments", DRIVER_MAPPINGS["appointments"]) +
          "\nUNION ALL\n" + passages_sql("patients", "patients", DRIVER_MAPPINGS["patients"]) +
          "\nUNION ALL\n" + passages_sql("doctors", "doctors", DRIVER_MAPPINGS["doctors"]))
def q_passages(spark, sf_dir):
    return _passages(Catalog(spark, sf_dir, spread=True))


@register("stable_ids", with_views("prescriptions") +
          "SELECT id, table_name, tenant_id, record_id FROM (" +
          passages_sql("prescriptions", "prescriptions", DRIVER_MAPPINGS["prescriptions"]) + ")")
def q_stable_ids(spark, sf_dir):
    p = build_passages(Catalog(spark, sf_dir, spread=True).prescriptions(), DRIVER_MAPPINGS["prescriptions"])
    return p.select("id", "table_name", "tenant_id", "record_id")


# A changed batch derived from the table: open appointments (status 4) are completed 30 days
# later; every 7th of them also has an intermediate version 10 days later (same id twice).
def _changed_batch(cat: Catalog) -> DataFrame:
    a = cat.appointments().where(F.col("status") == 4)
    late = a.withColumn("updated_at", F.col("opd_date") + F.expr("INTERVAL 30 DAYS")) \
        .withColumn("status", F.lit(1))
    mid = a.where(F.pmod(F.col("id"), F.lit(7)) == 0) \
        .withColumn("updated_at", F.col("opd_date") + F.expr("INTERVAL 10 DAYS")) \
        .withColumn("status", F.lit(0))
    return late.unionByName(mid)


_BATCH_SQL = """batch AS (
  SELECT id, tenant_id, patient_id, doctor_id, opd_date, 1 AS status, department_id, amount,
         created_at, opd_date + INTERVAL 30 DAY AS updated_at FROM appointments WHERE status = 4
  UNION ALL
  SELECT id, tenant_id, patient_id, doctor_id, opd_date, 0 AS status, department_id, amount,
         created_at, opd_date + INTERVAL 10 DAY AS updated_at FROM appointments WHERE status = 4 AND id % 7 = 0)"""

_STORE_SQL = (with_views("appointments") + ", " + _BATCH_SQL +
              ",\nstore AS (" + passages_sql("appointments", "appointments", DRIVER_MAPPINGS["appointments"]) +
              "),\nincoming AS (" + passages_sql("batch", "appointments", DRIVER_MAPPINGS["appointments"]) +
              "),\nnewest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
              "(PARTITION BY id ORDER BY updated_at DESC, text DESC) AS rn FROM incoming) WHERE rn = 1)\n")


@register("upsert_newest", _STORE_SQL +
          "SELECT * FROM store WHERE id NOT IN (SELECT id FROM newest) UNION ALL SELECT * FROM newest")
def q_upsert_newest(spark, sf_dir):
    cat = Catalog(spark, sf_dir, spread=True)
    m = DRIVER_MAPPINGS["appointments"]
    store = build_passages(cat.appointments(), m)
    incoming = build_passages(_changed_batch(cat), m)
    return upsert(store, incoming)


NEWEST_OF_ALL_SQL = _STORE_SQL + """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, text DESC) AS rn
          FROM (SELECT * FROM store UNION ALL SELECT * FROM incoming)) WHERE rn = 1"""


@register("store_out_of_order", NEWEST_OF_ALL_SQL)
def q_store_out_of_order(spark, sf_dir):
    """Versions reach the point store newest first: the changed rows, then the rows they were made of,
    in two merges, with a compaction in between."""
    cat, m = Catalog(spark, sf_dir), DRIVER_MAPPINGS["appointments"]
    store = point_store(spark, scratch_path(spark, "store-late"), max_deltas=2)
    first = cat.appointments()
    for rows in (_changed_batch(cat), first.where("id % 2 = 0"), first.where("id % 2 <> 0")):
        store.merge(build_passages(rows, m))
    return store.read()


@register("high_water", _STORE_SQL +
          """, old AS (SELECT tenant_id, table_name, max(updated_at) AS hw FROM store GROUP BY ALL),
              new AS (SELECT tenant_id, table_name, max(updated_at) AS hw FROM newest GROUP BY ALL)
          SELECT coalesce(o.tenant_id, n.tenant_id) AS tenant_id, coalesce(o.table_name, n.table_name) AS table_name,
                 greatest(o.hw, n.hw) AS high_water
          FROM old o FULL OUTER JOIN new n ON o.tenant_id = n.tenant_id AND o.table_name = n.table_name""")
def q_high_water(spark, sf_dir):
    cat = Catalog(spark, sf_dir, spread=True)
    m = DRIVER_MAPPINGS["appointments"]
    store = build_passages(cat.appointments(), m)
    old = high_water(store)
    incoming = build_passages(_changed_batch(cat), m)
    return high_water(incoming, old)


def _ingest_state(cat: Catalog) -> DataFrame:
    """Checkpoint state derived from the tables: each tenant's newest change minus one year."""
    frames = []
    for entity in ("appointments", "prescriptions"):
        df = getattr(cat, entity)()
        frames.append(df.groupBy("tenant_id").agg(
            (F.max("updated_at") - F.expr("INTERVAL 365 DAYS")).alias("high_water"))
            .select("tenant_id", F.lit(DRIVER_MAPPINGS[entity].table).alias("table_name"), "high_water"))
    return frames[0].unionByName(frames[1])


@register("ingest_incremental", with_views("appointments", "prescriptions") +
          """, state AS (
               SELECT tenant_id, 'appointments' AS table_name, max(updated_at) - INTERVAL 365 DAY AS hw
               FROM appointments GROUP BY tenant_id
               UNION ALL SELECT tenant_id, 'prescriptions', max(updated_at) - INTERVAL 365 DAY
               FROM prescriptions GROUP BY tenant_id),
             ca AS (SELECT a.* FROM appointments a JOIN state s ON s.tenant_id = a.tenant_id
                    AND s.table_name = 'appointments' WHERE a.updated_at > s.hw),
             cp AS (SELECT p.* FROM prescriptions p JOIN state s ON s.tenant_id = p.tenant_id
                    AND s.table_name = 'prescriptions' WHERE p.updated_at > s.hw)
          """ + passages_sql("ca", "appointments", DRIVER_MAPPINGS["appointments"]) + "\nUNION ALL\n" +
          passages_sql("cp", "prescriptions", DRIVER_MAPPINGS["prescriptions"]))
def q_ingest_incremental(spark, sf_dir):
    cat = Catalog(spark, sf_dir, spread=True)
    state = _ingest_state(cat)
    out = None
    for entity in ("appointments", "prescriptions"):
        m = DRIVER_MAPPINGS[entity]
        ch = changed_rows(getattr(cat, entity)(), m.table, state)
        p = build_passages(ch, m)
        out = p if out is None else out.unionByName(p)
    return out


# ---------------------------------------------------------------------------------------------
# the ingest job itself, and a search of what it stored
# ---------------------------------------------------------------------------------------------

STORE_QUESTION = "completed urgent appointment with a large amount"


def _ingested(spark, sf_dir) -> str:
    """Two runs of the job: all appointments, then the changed rows behind each tenant's mark."""
    cat, root = Catalog(spark, sf_dir), scratch_path(spark, "ingest")
    m = DRIVER_MAPPINGS["appointments"]
    for rows in (cat.appointments(), cat.appointments().unionByName(_changed_batch(cat))):
        run_incremental_ingest(spark, {"appointments": (rows, m)}, root + "/store", root + "/state", hashing_embedder(64))
    return root


@register("ingest_job", with_views("appointments") + ", " + _BATCH_SQL + """,
marks AS (SELECT tenant_id, max(updated_at) AS hw FROM appointments GROUP BY tenant_id),
changed AS (SELECT b.* FROM batch b JOIN marks USING (tenant_id) WHERE b.updated_at > hw),
store AS (""" + passages_sql("appointments", "appointments", DRIVER_MAPPINGS["appointments"]) +
          "),\nincoming AS (" + passages_sql("changed", "appointments", DRIVER_MAPPINGS["appointments"]) +
          "),\nnewest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
          "(PARTITION BY id ORDER BY updated_at DESC, text DESC) AS rn FROM incoming) WHERE rn = 1)\n"
          "SELECT * FROM store WHERE id NOT IN (SELECT id FROM newest) UNION ALL SELECT * FROM newest")
def q_ingest_job(spark, sf_dir):
    return point_store(spark, _ingested(spark, sf_dir) + "/store").read().drop("embedding")


@register("ingest_counters", with_views("appointments") + ", " + _BATCH_SQL + """,
marks AS (SELECT tenant_id, max(updated_at) AS hw FROM appointments GROUP BY tenant_id),
changed AS (SELECT DISTINCT b.id FROM batch b JOIN marks USING (tenant_id) WHERE b.updated_at > hw)
SELECT 1 AS run, count(*) AS processed, CAST(0 AS BIGINT) AS failed FROM appointments WHERE updated_at > TIMESTAMP '1970-01-01'
UNION ALL SELECT 2, count(*), 0 FROM changed""")
def q_ingest_counters(spark, sf_dir):
    """What two runs of the job count while they embed (A4)."""
    cat, root, m = Catalog(spark, sf_dir), scratch_path(spark, "counters"), DRIVER_MAPPINGS["appointments"]
    rows = []
    for n, source in enumerate((cat.appointments(), cat.appointments().unionByName(_changed_batch(cat))), 1):
        out = run_incremental_ingest(spark, {"appointments": (source, m)}, root + "/store", root + "/state", hashing_embedder(8))
        rows.append((n, out["processed"], out["failed"]))
    return spark.createDataFrame(rows, "run int, processed long, failed long")


@register("ingest_then_search")
def q_ingest_then_search(spark, sf_dir):
    """No SQL: the vectors come from the embedder (tests compare with a full scoring)."""
    return search_store(spark, _ingested(spark, sf_dir) + "/store", STORE_QUESTION, hashing_embedder(64), "1")
