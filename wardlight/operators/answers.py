"""Batched question answering: a table of intents becomes counts and rows in one plan.

``entity_query`` builds one plan per intent. Here the predicates are data: questions are rows, equal
predicate sets are one *signature*, and every target entity is one branch of the plan, however many
questions there are.

* Signatures with a name first find the ids whose name matches (``name_match``), then join the
  entity's rows on that id; the other predicates are checked on what is joined.
* Signatures without a name never meet rows. Rows are counted per *cell* (tenant, status,
  department, day, experience) and the cells are rolled up for every set of predicates that a
  signature may leave open, so a signature equi-joins the few cells of its own kind. The first ids of
  each cell give the rows of a list.

Per signature the smallest ids are kept, as many as its longest list asks for, by a rank that Spark
cuts before the exchange. Questions join their signature at the end.

The plan has dozens of joins. What grows with questions, people or rows is joined by sorting (``_by_merge``):
sides that are each just small enough to broadcast would be in the driver's memory all at once. Names
are matched once and kept in a checkpoint, as every target joins them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.dates import resolve_date_columns, ts_literal
from wardlight.functions.text import full_name
from wardlight.operators.entity_query import STARTS_WITH, department_ids, has_tenant, with_tenant
from wardlight.operators.name_match import containing
from wardlight.plans.intent import DEFAULT_LIMIT, DEFAULT_TARGET
from wardlight.session import checkpoint_root
from wardlight.sources.mapping import EntityMapping
from wardlight.sources.tables import STATUS_CODES

FILTERS = ("doctorName", "patientName", "department", "status", "date", "minExperience")
ANSWER = ["question_id", "target", "operation", "results_count", "record_ids", "ignored_filters", "error"]


def _given(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() if name == "minExperience" else F.coalesce(c != "", F.lit(False))


def _by_merge(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast, as it grows with the input."""
    return df.hint("merge")


def _slot(ts: Column) -> Column:
    """Two numbers a day: its instants up to 23:59:59.999, which end a date range, and those after."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    after = F.date_trunc("DAY", ts).cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")
    return day * 2 + F.when(ts.cast("timestamp_ntz") > after, 1).otherwise(0)


class _Target:
    """What one entity offers: its rows as the columns the predicates need, and its filters."""

    def __init__(self, tables: Mapping[str, DataFrame], mappings: dict[str, EntityMapping], name: str):
        m = mappings[name]
        base, tenant = with_tenant(tables, mappings, name)
        self.name, self.id_type = name, base.schema[m.physical("id")].dataType
        self.doctor = "id" if name == "doctors" else "doctor" if m.physical("doctor") and "doctors" in tables else None
        self.patient = "id" if name == "patients" else "patient" if name in ("appointments", "prescriptions") and "patients" in tables else None
        date = m.physical("scheduledAt") if name == "appointments" else m.physical("createdAt")
        self.columns = {"status": m.physical("status"), "department": m.physical("department"), "slot": date, "experience": m.physical("experience")}
        self.types = {c: base.schema[p].dataType for c, p in self.columns.items() if p}
        takes = {"doctorName": self.doctor, "patientName": self.patient, "department": self.columns["department"],
                 "status": self.columns["status"], "date": date, "minExperience": self.columns["experience"]}
        self.ignored = [f for f in FILTERS if not takes[f]]
        self.departments = department_ids(tables, m)

        def column(physical: str | None, kind: T.DataType | str) -> Column:
            return F.col(physical) if physical else F.lit(None).cast(kind)

        self.rows = base.select(
            F.col(m.physical("id")).alias("id"), F.col(tenant).cast("string").alias("tenant"),
            column(m.physical(self.doctor) if self.doctor else None, "bigint").cast("string").alias("doctor"),
            column(m.physical(self.patient) if self.patient else None, "bigint").cast("string").alias("patient"),
            column(self.columns["status"], "string").cast("string").alias("status"),
            column(self.columns["department"], "string").cast("string").alias("department"),
            (_slot(F.col(date)) if date else F.lit(None).cast("bigint")).alias("slot"),
            column(self.columns["experience"], "double").cast("double").alias("experience"))


def _predicates(questions: DataFrame, t: _Target, as_of: dt.datetime, unknown_date: str) -> DataFrame:
    """Questions with their predicates in the form that ``t.rows`` is compared with."""
    def of(name: str, value: Column, kind: str = "string") -> Column:
        return F.when(_given(name), value) if name not in t.ignored else F.lit(None).cast(kind)

    word = F.lower(F.trim("status"))
    if "status" in t.ignored or not isinstance(t.types["status"], T.NumericType):
        status, unknown = of("status", F.col("status")), F.lit(False)
    else:
        codes = F.create_map(*[F.lit(x) for w, c in STATUS_CODES.items() for x in (w, c)])
        code = F.when(word.rlike("^-?[0-9]+$"), word.try_cast("bigint")).otherwise(codes[word].cast("bigint"))
        status, unknown = of("status", code.cast("string")), _given("status") & code.isNull()
    kind = t.types.get("department", T.StringType())
    name = F.lower("patientName")
    starts = name.startswith(STARTS_WITH)
    rest = F.trim(F.substring(name, len(STARTS_WITH) + 1, 1 << 20))
    prefix = starts & (rest != "")
    start, end = resolve_date_columns(F.col("date"), ts_literal(as_of), unknown=unknown_date)
    dated = of("date", start.isNotNull(), "boolean")
    whole = F.coalesce(F.when(F.col("limit").isNotNull() & ~F.isnan("limit") & (F.col("limit") != 0), F.greatest(F.col("limit").cast("bigint"), F.lit(0))),
                       F.lit(DEFAULT_LIMIT))
    return questions.where(F.col("target") == t.name).select(
        "question_id", "target", "operation", (F.col("operation") == "aggregate").alias("counted"), whole.alias("limit"),
        F.when(unknown, F.concat(F.lit(f"unknown status word for {t.name}: "), F.col("status"))).alias("error"),
        F.array_join(F.array_compact(F.array(*[F.when(_given(f) & (start.isNotNull() if f == "date" else F.lit(True)), F.lit(f)) for f in t.ignored])), ",").alias("ignored_filters"),
        F.struct(F.col("tenant_id").cast("string").alias("tenant"), of("doctorName", F.lower("doctorName")).alias("doctor"),
                 of("patientName", F.when(prefix, rest).otherwise(name)).alias("patient"),
                 of("patientName", prefix, "boolean").alias("prefix"), status.alias("status"),
                 of("department", F.lower("department") if t.departments is not None
                    else F.coalesce(F.col("department").try_cast(kind).cast("string"), F.lit("\x00"))).alias("department"),
                 F.when(dated, 2 * F.datediff(F.to_date(start), F.lit("1970-01-01").cast("date")).cast("bigint")).alias("first"),
                 F.when(dated, 2 * F.datediff(F.to_date(end), F.lit("1970-01-01").cast("date")).cast("bigint")).alias("last"),
                 of("minExperience", F.col("minExperience").cast("double"), "double").alias("least")).alias("want"))


def _fits(departments: Column | None = None) -> Column:
    """Whether a row passes the predicates that are no names."""
    def ok(want: str, test: Column) -> Column:
        return F.col(want).isNull() | F.coalesce(test, F.lit(False))

    return (ok("want.status", F.col("status") == F.col("want.status"))
            & ok("want.department", departments if departments is not None else F.col("department") == F.col("want.department"))
            & ok("want.first", F.col("slot").between(F.col("want.first"), F.col("want.last")))
            & ok("want.least", F.col("experience") >= F.col("want.least")))


def _named(signatures: DataFrame, t: _Target, doctors: DataFrame | None, patients: DataFrame | None, known: DataFrame | None) -> DataFrame:
    """(sig, id) of the signatures with a name: ids of the name first, then the rows with them."""
    rows = t.rows
    out = []

    def checked(found: DataFrame) -> DataFrame:
        if known is not None:
            found = found.join(known, (F.col("want.department") == F.col("asked")) & (F.col("department") == F.col("known")), "left")
            return found.where(_fits(F.col("known").isNotNull())).drop("asked", "known")
        return found.where(_fits())

    same = F.col("want.tenant") == F.col("tenant")
    if t.patient:
        own = signatures.where("want.patient is not null").join(_by_merge(patients), F.col("want.patient") == F.col("p_needle")) \
            .where(~F.col("want.prefix") | F.col("p_name").startswith(F.col("want.patient")))
        found = own.join(_by_merge(rows), (F.col("p_id") == F.col("patient")) & same)
        if t.doctor:
            found = found.join(_by_merge(doctors), (F.col("want.doctor") == F.col("d_needle")) & (F.col("doctor") == F.col("d_id")), "left") \
                .where("want.doctor is null or d_id is not null")
        out.append(checked(found).select("sig", "id"))
    if t.doctor:
        own = signatures.where("want.patient is null and want.doctor is not null").join(_by_merge(doctors), F.col("want.doctor") == F.col("d_needle"))
        out.append(checked(own.join(_by_merge(rows), (F.col("d_id") == F.col("doctor")) & same)).select("sig", "id"))
    if not out:
        return rows.select(F.lit("").alias("sig"), "id").limit(0)
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


_OPEN = ("status", "department", "slot", "experience")


def _levels(rows: DataFrame, t: _Target) -> DataFrame:
    """Rows once per set of predicates: the cell columns outside of the set are null, ``kind`` names it.
    A row without a value is in no cell of a set that asks for it."""
    open_ = [c for c in _OPEN if t.columns[c]]
    sets = [F.struct(*[F.lit(bool(n >> i & 1)).alias(c) for i, c in enumerate(open_)]) for n in range(1 << len(open_))] if open_ else None
    if sets is None:
        return rows.withColumn("kind", F.lit(""))
    out = rows.withColumn("set", F.explode(F.array(*sets)))
    kept = F.lit(True)
    for c in open_:
        kept = kept & (~F.col("set")[c] | F.col(c).isNotNull())
    kind = F.concat(*[F.when(F.col("set")[c], F.lit(c[0])).otherwise(F.lit("")) for c in open_])
    return out.where(kept).withColumn("kind", kind).withColumns({c: F.when(F.col("set")[c], F.col(c)) for c in open_}).drop("set")


def _unnamed(signatures: DataFrame, t: _Target, known: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame]:
    """(sig, n) and (sig, id) of the signatures without a name, by way of cells."""
    cell = ["tenant", *_OPEN]
    rows = t.rows
    bare = signatures.where("want.patient is null and want.doctor is null")
    if known is not None:                            # a department word may stand for several ids
        bare = bare.join(known, F.col("want.department") == F.col("asked"), "left").where("want.department is null or known is not null") \
            .withColumn("dept", F.col("known")).drop("asked", "known")
    else:
        bare = bare.withColumn("dept", F.col("want.department"))
    asked = [("status", "want.status"), ("department", "dept"), ("slot", "want.first"), ("experience", "want.least")]
    kind = F.concat(*[F.when(F.col(w).isNotNull(), F.lit(c[0])).otherwise(F.lit("")) for c, w in asked if t.columns[c]], F.lit(""))
    bare = bare.withColumn("kind", kind)

    def meets(cells: DataFrame) -> DataFrame:
        cells = cells.select(*[F.col(c).alias(f"c_{c}") for c in [*cell, "kind"]], *[c for c in cells.columns if c not in [*cell, "kind"]])
        return bare.join(cells, (F.col("want.tenant") == F.col("c_tenant")) & (F.col("kind") == F.col("c_kind"))
                         & F.col("want.status").eqNullSafe(F.col("c_status")) & F.col("dept").eqNullSafe(F.col("c_department"))
                         & (F.col("want.first").isNull() | F.col("c_slot").between(F.col("want.first"), F.col("want.last")))
                         & (F.col("want.least").isNull() | (F.col("c_experience") >= F.col("want.least"))))

    counts = _levels(rows.groupBy(*cell).agg(F.count("*").alias("n")), t).groupBy(*cell, "kind").agg(F.sum("n").alias("n"))
    first = rows.select(*cell, "id").withColumn("r", F.row_number().over(Window.partitionBy(*cell).orderBy("id"))).where(F.col("r") <= most)
    first = _levels(first.drop("r"), t)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy(*cell, "kind").orderBy("id"))).where(F.col("r") <= most).drop("r")
    return meets(counts).groupBy("sig").agg(F.sum("n").alias("n")), meets(first).select("sig", "id")


def _names(tables: Mapping[str, DataFrame], mappings: dict[str, EntityMapping], entity: str, needles: DataFrame, p: str) -> DataFrame | None:
    """(p_needle, p_id, p_name): the doctors or patients whose full name contains a needle."""
    if entity not in tables:
        return None
    m = mappings[entity]
    people = tables[entity].select(F.lit("").alias("scope"), F.col(m.physical("id")).cast("string").alias(f"{p}_id"),
                                   F.lower(full_name(F.col(m.physical("firstName")), F.col(m.physical("lastName")))).alias("name"))
    checkpoint_root(needles.sparkSession)
    return containing(needles.select(F.lit("").alias("scope"), "needle"), people).select(
        F.col("needle").alias(f"{p}_needle"), f"{p}_id", F.col("name").alias(f"{p}_name")).checkpoint()


def answer_questions(tables: Mapping[str, DataFrame], mappings: dict[str, EntityMapping], questions: DataFrame,
                     as_of: dt.datetime, unknown_date: str = "today") -> DataFrame:
    """One row per question: the count of an aggregate, or the first ids (as text, ascending) of a list,
    with the number of rows found; the filters the target doesn't know; and an error instead of both.

    ``questions``: question_id, tenant_id, operation, target, doctorName, patientName, department,
    status, date, minExperience, limit. Rules are those of ``entity_query``: names match by contains
    (patients also by ``starts with``), status words by their codes, dates in whole days, an invalid date
    drops the filter, no limit is five. Every question is answered within its tenant. Repeated question
    ids are answered row by row.
    """
    ask = questions.withColumns({
        "target": F.when(_given("target"), F.col("target")).otherwise(DEFAULT_TARGET), "limit": F.col("limit").cast("double")})
    targets = [n for n in mappings if n in tables and mappings[n].physical("id") and has_tenant(tables, mappings, n)]
    needles = ask.select(F.lower("doctorName").alias("needle")).where("needle <> ''")
    doctors = _names(tables, mappings, "doctors", needles, "d")
    name = F.lower("patientName")
    rest = F.trim(F.substring(name, len(STARTS_WITH) + 1, 1 << 20))
    needles = ask.select(F.when(name.startswith(STARTS_WITH) & (rest != ""), rest).otherwise(name).alias("needle")).where("needle <> ''")
    patients = _names(tables, mappings, "patients", needles, "p")
    # the longest list: how many ids a cell may have to give
    most = ask.where("operation <> 'aggregate'").agg(F.max(F.when(~F.isnan("limit"), F.col("limit")))).first()[0]
    most = max(int(most or 0), DEFAULT_LIMIT)
    out = None
    for target in targets:
        t = _Target(tables, mappings, target)
        wanted = _predicates(ask, t, as_of, unknown_date).withColumn("sig", F.md5(F.to_json("want", {"ignoreNullFields": "false"})))
        signatures = wanted.where("error is null").groupBy("sig").agg(
            F.first("want").alias("want"), F.max(F.when(~F.col("counted"), F.col("limit"))).alias("top"))
        known = None
        if t.departments is not None:
            words = wanted.select(F.lit("").alias("scope"), F.col("want.department").alias("needle"))
            known = _department_matches(words, t.departments)
        named = _named(signatures, t, doctors, patients, known)
        counts, ids = _unnamed(signatures, t, known, most)
        counts = counts.unionByName(named.groupBy("sig").agg(F.count("*").alias("n")))
        ranked = (ids.unionByName(named).join(_by_merge(signatures.where("top > 0").select("sig", "top")), "sig")
                  .withColumn("r", F.row_number().over(Window.partitionBy("sig").orderBy("id"))).where("r <= top"))
        lists = ranked.groupBy("sig").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("id").cast("string").alias("id")))),
                                                      lambda x: x["id"]).alias("ids"))
        found = wanted.join(_by_merge(counts), "sig", "left").join(_by_merge(lists), "sig", "left")
        ids = F.slice(F.coalesce("ids", F.array().cast("array<string>")), F.lit(1), F.col("limit").cast("int"))
        found = found.withColumn("record_ids", F.when(F.col("error").isNull() & ~F.col("counted"), ids))
        count = F.when(F.col("counted"), F.coalesce("n", F.lit(0))).otherwise(F.size("record_ids"))
        found = found.withColumn("results_count", F.when(F.col("error").isNull(), count).cast("bigint")).select(*ANSWER)
        out = found if out is None else out.unionByName(found)
    nobody = ask.where(~F.col("target").isin(targets)).select(
        "question_id", "target", "operation", F.lit(None).cast("bigint").alias("results_count"), F.lit(None).cast("array<string>").alias("record_ids"),
        F.lit("").alias("ignored_filters"), F.concat(F.lit("Unsupported target entity: "), F.col("target")).alias("error"))
    return nobody if out is None else out.unionByName(nobody)


def _department_matches(words: DataFrame, departments: DataFrame) -> DataFrame:
    """(asked, known): ids of the departments that a lower-cased word names, by name or by id."""
    by_name = containing(words, departments.select(F.lit("").alias("scope"), F.lower("name").alias("name"), "id")) \
        .select(F.col("needle").alias("asked"), F.col("id").alias("known"))
    by_id = words.join(departments, F.col("needle") == F.lower("id")).select(F.col("needle").alias("asked"), F.col("id").alias("known"))
    return by_name.unionByName(by_id).distinct()


def answer_records(tables: Mapping[str, DataFrame], mappings: dict[str, EntityMapping], answers: DataFrame, target: str) -> DataFrame:
    """question_id, rank and the whole row of every listed record of one entity."""
    key = F.col(mappings[target].physical("id"))
    listed = answers.where(F.col("target") == target).select("question_id", F.posexplode("record_ids").alias("_at", "_id"))
    return (listed.join(_by_merge(tables[target]), F.col("_id") == key.cast("string"))
            .select("question_id", (F.col("_at") + 1).cast("int").alias("rank"), *tables[target].columns))
