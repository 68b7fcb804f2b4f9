"""Registered document queries: S14 (first_source_items) and P1 (prescription_documents)."""

from __future__ import annotations

from wardlight.operators.documents import deal_by_tenant, documents_for_selection, first_source, prescription_document_lines, write_documents
from wardlight.operators.entity_query import entity_query
from wardlight.plans.intent import Intent
from wardlight.plans.registry import AS_OF
from wardlight.sources.tables import DRIVER_MAPPINGS
from wardlight.plans.oracle_views import with_views
from wardlight.plans.registry import register
from wardlight.session import scratch_path
from wardlight.sources.tables import HEADER_CANDIDATES, ITEM_CANDIDATES, Catalog, read_by_tenant

_ITEM_COLS = ("prescription_id, source_table, line_no, part_id, supplier_id, price, medicine_name, "
              "dosage, duration, time, comment")

_FIRST_ITEMS_SQL = """first_items AS (
  SELECT i.* FROM items i JOIN (
    SELECT prescription_id, min(CASE source_table WHEN 'prescription_medicines' THEN 0
                                 WHEN 'prescription_items' THEN 1 WHEN 'opd_prescription_items' THEN 2 END) AS pr
    FROM items GROUP BY prescription_id) m
  ON m.prescription_id = i.prescription_id
 AND m.pr = CASE i.source_table WHEN 'prescription_medicines' THEN 0
                                WHEN 'prescription_items' THEN 1 WHEN 'opd_prescription_items' THEN 2 END)"""


def _first_items(cat: Catalog, method: str = "aggregate"):
    """Winning candidate rows per prescription, then the medicine name (one dimension join)."""
    tables = cat.item_tables()
    won = first_source([(t, tables.get(t)) for t in ITEM_CANDIDATES], "prescription_id", method)
    return cat.with_medicine_names(won)


@register("first_source_items", with_views("items") + ", " + _FIRST_ITEMS_SQL +
          f"\nSELECT {_ITEM_COLS} FROM first_items")
def q_first_source_items(spark, sf_dir):
    return _first_items(Catalog(spark, sf_dir)).select(*[c.strip() for c in _ITEM_COLS.split(",")])


_DOC_SQL = with_views("patients", "doctors", "prescriptions", "items") + ", " + _FIRST_ITEMS_SQL + """,
sel AS (SELECT id FROM prescriptions),
hdr AS (SELECT r.id, r.tenant_id, coalesce(nullif(r.problem, ''), '') AS problem,
               coalesce(nullif(r.test, ''), '') AS tests, coalesce(nullif(r.advice, ''), '') AS advice,
               r.created_at, p.first_name AS pf, p.last_name AS pl,
               coalesce(nullif(p.gender, ''), 'N/A') AS gender, coalesce(nullif(p.dob, ''), 'N/A') AS dob,
               d.first_name AS df, d.last_name AS dl,
               coalesce(nullif(d.specialist, ''), 'General Physician') AS spec
        FROM prescriptions r JOIN patients p ON p.id = r.patient_id JOIN doctors d ON d.id = r.doctor_id
        WHERE r.id IN (SELECT id FROM sel)),
it AS (SELECT f.*, h.tenant_id AS htenant,
              row_number() OVER (PARTITION BY f.prescription_id ORDER BY f.line_no, f.part_id, f.supplier_id, f.price) AS n
       FROM first_items f JOIN hdr h ON h.id = f.prescription_id),
lines AS (
  SELECT id AS pid, tenant_id, 0 AS section, 0 AS item_no, 0 AS sub, 'PRESCRIPTION' AS line FROM hdr
  UNION ALL SELECT id, tenant_id, 1, 0, 0, 'Dr. ' || df || ' ' || dl FROM hdr
  UNION ALL SELECT id, tenant_id, 1, 0, 1, spec FROM hdr
  UNION ALL SELECT id, tenant_id, 2, 0, 0, 'PATIENT INFORMATION' FROM hdr
  UNION ALL SELECT id, tenant_id, 2, 0, 1, 'Name: ' || pf || ' ' || pl FROM hdr
  UNION ALL SELECT id, tenant_id, 2, 0, 2, 'Gender: ' || gender || ' | Date of Birth: ' || dob FROM hdr
  UNION ALL SELECT id, tenant_id, 2, 0, 3, 'Date: ' || strftime(created_at, '%Y-%m-%d') FROM hdr
  UNION ALL SELECT id, tenant_id, 3, 0, 0, 'DIAGNOSIS / CHIEF COMPLAINT' FROM hdr WHERE problem <> ''
  UNION ALL SELECT id, tenant_id, 3, 0, 1, problem FROM hdr WHERE problem <> ''
  UNION ALL SELECT id, tenant_id, 4, 0, 0, 'RX / MEDICATIONS' FROM hdr
  UNION ALL SELECT id, tenant_id, 6, 0, 0, 'ADVICE & TESTS' FROM hdr WHERE tests <> '' OR advice <> ''
  UNION ALL SELECT id, tenant_id, 6, 0, 1, 'Tests: ' || tests FROM hdr WHERE tests <> ''
  UNION ALL SELECT id, tenant_id, 6, 0, 2, 'Advice: ' || advice FROM hdr WHERE advice <> ''
  UNION ALL SELECT id, tenant_id, 7, 0, 0, 'This is a computer-generated prescription.' FROM hdr
  UNION ALL SELECT prescription_id, htenant, 5, CAST(n AS INTEGER), 0,
                   CAST(n AS VARCHAR) || '. ' || coalesce(nullif(medicine_name, ''), 'Unknown Medicine') FROM it
  UNION ALL SELECT prescription_id, htenant, 5, CAST(n AS INTEGER), 1,
                   '   Dosage: ' || coalesce(nullif(dosage, ''), 'As directed') || ' | Duration: '
                   || coalesce(nullif(duration, ''), 'N/A') || ' | Time: ' || coalesce(nullif(time, ''), 'N/A') FROM it
  UNION ALL SELECT prescription_id, htenant, 5, CAST(n AS INTEGER), 2, '   Note: ' || comment FROM it WHERE comment <> ''
  UNION ALL SELECT id, tenant_id, 5, 0, 0, 'No medications listed.' FROM hdr h
            WHERE NOT EXISTS (SELECT 1 FROM first_items f WHERE f.prescription_id = h.id))
SELECT tenant_id, pid AS prescription_id, 'prescriptions/' || tenant_id || '/' || CAST(pid AS VARCHAR) AS doc_path,
       section, item_no, sub, line FROM lines"""


def _documents(spark, sf_dir, **kw):
    cat = Catalog(spark, sf_dir)
    headers = first_source([(t, cat.prescriptions() if t == "prescriptions" else None)
                            for t in HEADER_CANDIDATES], "id")
    return prescription_document_lines(headers, cat.patients(), cat.doctors(), _first_items(cat),
                                       order_cols=("line_no", "part_id", "supplier_id", "price"), **kw)


@register("prescription_documents", _DOC_SQL)
def q_prescription_documents(spark, sf_dir):
    return _documents(spark, sf_dir)


@register("documents_sink", _DOC_SQL)
def q_documents_sink(spark, sf_dir):
    """The lines of all documents, written to a folder per tenant and read back."""
    path = scratch_path(spark, "documents")
    write_documents(_documents(spark, sf_dir, deal=deal_by_tenant), path, dealt=True)
    return read_by_tenant(spark, path)


_EXPORT_SEL = """sel AS (SELECT r.id FROM prescriptions r JOIN patients p ON p.id = r.patient_id
        WHERE r.tenant_id = '0' AND contains(lower(p.first_name || ' ' || p.last_name), 'customer 00000010')
        ORDER BY r.id LIMIT 100),"""


@register("export_documents", _DOC_SQL.replace("sel AS (SELECT id FROM prescriptions),", _EXPORT_SEL))
def q_export_documents(spark, sf_dir):
    """Export flow: the PDF words force export_pdf on prescriptions; Q1 selects the patient's
    prescriptions; documents are built for every selected prescription."""
    cat = Catalog(spark, sf_dir)
    intent = Intent.of("export_pdf", ["prescriptions", "patients"], patientName="customer 00000010", limit=100)
    selected = entity_query(cat.tables(), DRIVER_MAPPINGS, intent, "0", AS_OF)
    tables = cat.item_tables()
    return documents_for_selection(selected, cat.prescriptions(), cat.patients(), cat.doctors(),
                                   [(t, tables.get(t)) for t in ITEM_CANDIDATES], finish=cat.with_medicine_names,
                                   order_cols=("line_no", "part_id", "supplier_id", "price"))
