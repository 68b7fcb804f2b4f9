"""Prescription documents for every selected prescription (P1), built from prioritised candidate
tables (S14), a 3-way header join (J3), a left item join (J4), display fallbacks (X15) and item
numbering (X16), written per tenant (S15).

A document is emitted as *lines* ``(tenant_id, prescription_id, doc_path, section, item_no, sub,
line)``: nothing collects a prescription's items into one row, and item numbering is range-based
(``functions.numbering``), so a prescription holding a third of all items is still spread over
many tasks. ``document_bodies`` joins lines into one text per document for callers that want
whole texts (bounded by the document's own size).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.numbering import HOT_GROUP_ROWS, number_within
from wardlight.functions.text import truthy_or

# Section labels and fallbacks of the document layout.
SPEC_DEFAULT = "General Physician"
PATIENT_SECTION = "PATIENT INFORMATION"
DIAGNOSIS_SECTION = "DIAGNOSIS / CHIEF COMPLAINT"
RX_SECTION = "RX / MEDICATIONS"
NO_ITEMS = "No medications listed."
ADVICE_SECTION = "ADVICE & TESTS"
NOT_AVAILABLE = "N/A"
DOSAGE_DEFAULT = "As directed"
MEDICINE_DEFAULT = "Unknown Medicine"
# Display-field candidate columns, in fallback order.
SPEC_COLUMNS = ("specialist", "speciality", "specialty", "doctor_speciality")
PROBLEM_COLUMNS = ("problem", "diagnosis", "chief_complaint")
ADVICE_COLUMNS = ("advice", "note")
TEST_COLUMNS = ("test", "investigation")
MED_NAME_COLUMNS = ("medicine_name", "name", "item_name")
DOSAGE_COLUMNS = ("dosage", "dose")
TIME_COLUMNS = ("time", "timing")
NOTE_COLUMNS = ("comment", "note")

DEFAULT_HEADING = "PRESCRIPTION"
DEFAULT_FOOTER = "This is a computer-generated prescription."


def first_source(candidates: list[tuple[str, DataFrame | None]], key: str,
                 method: str = "aggregate") -> DataFrame:
    """Per ``key``, rows of the first candidate table (in list order) that has any.

    Absent tables (``None``) are skipped; a single existing candidate is returned as is.
    ``method="aggregate"``: the winning priority per key is a partial aggregate (``min``) joined
    back with a semi join on ``(key, priority)`` — a hot key is combined map-side and the join
    can be split by AQE, at the price of reading the candidates twice. The winners, one narrow row
    per key, are hashed: sorting the candidates would hold a partition's whole rows in a task.
    ``method="window"``: ``min(priority) over (partition by key)`` — one pass and one exchange,
    whose partitioning later per-key steps (joins, numbering) reuse.
    """
    frames = []
    for prio, (name, df) in enumerate(candidates):
        if df is None:
            continue
        frames.append(df.withColumn("source_table", F.lit(name)).withColumn("_prio", F.lit(prio)))
    if not frames:
        raise ValueError("no candidate table exists")
    if len(frames) == 1:
        return frames[0].drop("_prio")
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    if method == "window":
        w = Window.partitionBy(key)
        return u.withColumn("_best", F.min("_prio").over(w)).where(F.col("_prio") == F.col("_best")) \
            .drop("_prio", "_best")
    best = u.groupBy(key).agg(F.min("_prio").alias("_best"))
    best = best.select(F.col(key).alias("_bk"), "_best").hint("shuffle_hash")
    out = u.join(best, (F.col(key) == F.col("_bk")) & (F.col("_prio") == F.col("_best")), "left_semi")
    return out.drop("_prio")


def _pick(df: DataFrame, names: tuple[str, ...], default: str | None = None) -> Column:
    """``a || b || c || default`` over the candidate columns that exist in ``df``."""
    cols = [F.col(c).cast("string") for c in names if c in df.columns]
    if not cols:
        return F.lit(default) if default is not None else F.lit(None).cast("string")
    return truthy_or(*cols, default=default)


def _line(section: int, item_no, sub: int, text: Column, when: Column | None = None) -> Column:
    item = item_no if isinstance(item_no, Column) else F.lit(item_no)
    s = F.struct(F.lit(section).alias("section"), item.cast("int").alias("item_no"),
                 F.lit(sub).alias("sub"), text.alias("line"))
    return s if when is None else F.when(when, s)


def prescription_document_lines(prescriptions: DataFrame, patients: DataFrame, doctors: DataFrame,
                                items: DataFrame, *, heading: str = DEFAULT_HEADING,
                                footer: str = DEFAULT_FOOTER, order_cols: tuple[str, ...] = ("line_no",),
                                hot_group_rows: int | None = HOT_GROUP_ROWS,
                                materialize: bool = True,
                                deal: Callable[[DataFrame, str], DataFrame] = lambda rows, tenant: rows) -> DataFrame:
    """P1 as lines. ``items`` already holds the winning candidate rows (see ``first_source``);
    ``order_cols`` must order a prescription's items uniquely. ``deal`` may exchange the headers and the
    items, given the name of their tenant column, before their lines are made."""
    p = patients.select(F.col("id").alias("_pid"), F.col("first_name").alias("patient_first_name"),
                        F.col("last_name").alias("patient_last_name"), F.col("gender").alias("patient_gender"),
                        F.col("dob").alias("patient_dob"))
    dcols = [F.col("id").alias("_did"), F.col("first_name").alias("doctor_first_name"),
             F.col("last_name").alias("doctor_last_name")] + \
        [F.col(c) for c in SPEC_COLUMNS if c in doctors.columns]
    d = doctors.select(*dcols)
    h = (prescriptions.join(p, prescriptions["patient_id"] == F.col("_pid"), "inner")
         .join(d, prescriptions["doctor_id"] == F.col("_did"), "inner"))
    spec = _pick(h, SPEC_COLUMNS, SPEC_DEFAULT)
    problem = _pick(h, PROBLEM_COLUMNS, "")
    advice = _pick(h, ADVICE_COLUMNS, "")
    tests = _pick(h, TEST_COLUMNS, "")
    gender = _pick(h, ("patient_gender",), NOT_AVAILABLE)
    dob = _pick(h, ("patient_dob",), NOT_AVAILABLE)
    # a header without a creation time shows the day the document is built
    date_s = F.date_format(F.coalesce(F.col("created_at").cast("timestamp_ntz"),
                                      F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd")
    has_problem, has_tests, has_advice = problem != "", tests != "", advice != ""
    header_lines = [
        _line(0, 0, 0, F.lit(heading)),
        _line(1, 0, 0, F.concat(F.lit("Dr. "), F.col("doctor_first_name"), F.lit(" "), F.col("doctor_last_name"))),
        _line(1, 0, 1, spec),
        _line(2, 0, 0, F.lit(PATIENT_SECTION)),
        _line(2, 0, 1, F.concat(F.lit("Name: "), F.col("patient_first_name"), F.lit(" "), F.col("patient_last_name"))),
        _line(2, 0, 2, F.concat(F.lit("Gender: "), gender, F.lit(" | Date of Birth: "), dob)),
        _line(2, 0, 3, F.concat(F.lit("Date: "), date_s)),
        _line(3, 0, 0, F.lit(DIAGNOSIS_SECTION), has_problem),
        _line(3, 0, 1, problem, has_problem),
        _line(4, 0, 0, F.lit(RX_SECTION)),
        _line(6, 0, 0, F.lit(ADVICE_SECTION), has_tests | has_advice),
        _line(6, 0, 1, F.concat(F.lit("Tests: "), tests), has_tests),
        _line(6, 0, 2, F.concat(F.lit("Advice: "), advice), has_advice),
        _line(7, 0, 0, F.lit(footer)),
    ]
    # per-prescription item counts: one partial aggregate, used for the hot-group check and for
    # the "no items" line; folded into the headers so they are read, never re-joined
    from wardlight.session import checkpoint_root
    if materialize:
        checkpoint_root(h.sparkSession)
        items = items.checkpoint(eager=True)
    counts = items.groupBy("prescription_id").agg(F.count(F.lit(1)).alias("_n_items"))
    h = h.join(counts.select(F.col("prescription_id").alias("_cid"), "_n_items"),
               F.col("id") == F.col("_cid"), "left")
    if materialize:
        h = h.checkpoint(eager=True)
    no_items = F.col("_n_items").isNull()
    header_lines.append(_line(5, 0, 0, F.lit(NO_ITEMS), no_items))
    keys = deal(h, "tenant_id").select(F.col("id").alias("prescription_id"), "tenant_id",
                    F.filter(F.array(*header_lines), lambda x: x.isNotNull()).alias("_lines"))
    head = keys.select("prescription_id", "tenant_id", F.explode("_lines").alias("l"))

    # item lines: items are the left (streamed, AQE-splittable) side of the join, and numbering
    # never puts a whole prescription into one task when one is hot
    biggest, rows = h.agg(F.max("_n_items"), F.sum("_n_items")).first()
    numbered = number_within(items, "prescription_id", list(order_cols), "_n", hot_group_rows, biggest or 0, rows or 0)
    hk = h.where(~no_items).select(F.col("id").alias("_hid"), F.col("tenant_id").alias("_htenant"))
    it = deal(numbered.join(hk, F.col("prescription_id") == F.col("_hid"), "inner"), "_htenant")
    name = _pick(it, MED_NAME_COLUMNS, MEDICINE_DEFAULT)
    dosage = _pick(it, DOSAGE_COLUMNS, DOSAGE_DEFAULT)
    duration = _pick(it, ("duration",), NOT_AVAILABLE)
    tme = _pick(it, TIME_COLUMNS, NOT_AVAILABLE)
    note = _pick(it, NOTE_COLUMNS, "")
    n = F.col("_n")
    item_lines = F.array(
        _line(5, n, 0, F.concat(n.cast("string"), F.lit(". "), name)),
        _line(5, n, 1, F.concat(F.lit("   Dosage: "), dosage, F.lit(" | Duration: "), duration,
                                F.lit(" | Time: "), tme)),
        _line(5, n, 2, F.concat(F.lit("   Note: "), note), note != ""),
    )
    body = it.select("prescription_id", F.col("_htenant").alias("tenant_id"),
                     F.explode(F.filter(item_lines, lambda x: x.isNotNull())).alias("l"))
    lines = head.unionByName(body)
    return lines.select(
        "tenant_id", "prescription_id",
        F.concat(F.lit("prescriptions/"), F.col("tenant_id"), F.lit("/"),
                 F.col("prescription_id").cast("string")).alias("doc_path"),
        F.col("l.section").alias("section"), F.col("l.item_no").alias("item_no"),
        F.col("l.sub").alias("sub"), F.col("l.line").alias("line"))


def documents_for_selection(selected: DataFrame, prescriptions: DataFrame, patients: DataFrame,
                            doctors: DataFrame, candidates: list[tuple[str, DataFrame | None]],
                            id_col: str = "id", finish: Callable[[DataFrame], DataFrame] = lambda items: items,
                            **kw) -> DataFrame:
    """P1 for every prescription a query selected (F9 in batch form: a semi join on the selected
    ids instead of one point lookup per id; the reference exported only the first row).

    The item ``candidates`` are cut to the selected ids before the first non-empty one is chosen, so
    no aggregate reads the items of other prescriptions; ``finish`` adds columns to the chosen items.
    Nothing is materialised."""
    ids = selected.select(F.col(id_col).alias("_sel")).distinct()
    rx = prescriptions.join(ids, F.col("id") == F.col("_sel"), "left_semi")
    cut = [(name, None if df is None else df.join(ids, F.col("prescription_id") == F.col("_sel"), "left_semi"))
           for name, df in candidates]
    return prescription_document_lines(rx, patients, doctors, finish(first_source(cut, "prescription_id")),
                                       **{"materialize": False, **kw})


def document_bodies(lines: DataFrame) -> DataFrame:
    """One text per document (lines joined by newline, in layout order)."""
    agg = lines.groupBy("tenant_id", "prescription_id", "doc_path").agg(
        F.array_sort(F.collect_list(F.struct("section", "item_no", "sub", "line"))).alias("_l"))
    return agg.select("tenant_id", "prescription_id", "doc_path",
                      F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("body"))


def deal_by_tenant(rows: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """Rows rebalanced by tenant: AQE joins small tenants into one task and splits a tenant with a third
    of all rows into many, so the number of files follows the bytes, not tasks times tenants."""
    return rows.hint("rebalance", tenant)


def write_documents(lines: DataFrame, path: str, dealt: bool = False) -> None:
    """One folder per tenant, rows sorted by (document, layout) inside each file.

    Lines are dealt by tenant (a huge document may span files; readers order by ``prescription_id, section,
    item_no, sub``). ``dealt``: they were made of headers and items that were dealt so, which is a
    fraction of the bytes of the lines."""
    ((lines if dealt else deal_by_tenant(lines)).sortWithinPartitions("tenant_id", "prescription_id", "section", "item_no", "sub")
     .write.mode("overwrite").partitionBy("tenant_id").parquet(path))
