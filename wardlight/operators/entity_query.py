"""Q1: an intent becomes one lazy DataFrame over the mapped entity tables.

No SQL text is generated: each filter is a native Column expression resolved through the entity
mapping, so Catalyst pushes it to the scan, turns the name ``EXISTS`` into a ``LeftSemi`` join and
plans ``orderBy(id).limit(n)`` as ``TakeOrderedAndProject`` (per-partition top-n, no global sort).
Joined sides are filtered *before* the join, so the semi-join build side is only the matching
doctors/patients; AQE broadcasts it when its runtime size is under the threshold and shuffles
otherwise.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.dates import InvalidDate, resolve_date_range, ts_literal
from wardlight.functions.text import full_name, name_contains, name_prefix
from wardlight.plans.intent import Intent
from wardlight.sources.mapping import EntityMapping
from wardlight.sources.tables import STATUS_CODES

# Fixed value: the prefix form of a patient-name filter.
STARTS_WITH = "starts with "


@dataclass
class EntityQuery:
    df: DataFrame
    target: str
    aggregate: bool
    ignored_filters: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def tenant_predicate(df: DataFrame, col: str, tenant: str | int) -> Column:
    """``col = tenant`` with the literal typed like the column (keeps the filter pushable)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        return F.col(col) == F.lit(str(tenant))
    s = str(tenant)
    if s.lstrip("-").isdigit():
        return F.col(col) == F.lit(int(s)).cast(dtype)
    return F.lit(False)


# Aliases of keys that lead to a parent entity, nearest first.
PARENT_KEYS = (("schedule", "schedules"), ("appointment", "appointments"), ("prescription", "prescriptions"),
               ("patient", "patients"), ("doctor", "doctors"))


def tenant_parent(tables: Mapping[str, DataFrame], mappings: dict[str, EntityMapping], name: str) -> tuple[str, str]:
    """For an entity without a tenant column: its key column and the parent entity that has the tenant,
    itself or through a parent of its own. The mapping's ``tenantVia`` decides, else the first known
    key alias that leads to a tenant."""
    m = mappings[name]
    for alias, parent in [m.tenant_via] if m.tenant_via else PARENT_KEYS:
        if m.physical(alias) and parent != name and has_tenant(tables, mappings, parent):
            return m.physical(alias), parent
    raise ValueError(f"entity {name} has no tenant column, and no mapped parent that has one")


def has_tenant(tables: Mapping[str, DataFrame], mappings: dict[str, EntityMapping], name: str) -> bool:
    """Whether the entity exists and has a tenant, of its own or through parents."""
    if name not in mappings or name not in tables:
        return False
    if mappings[name].tenant_column:
        return True
    try:
        return bool(tenant_parent(tables, mappings, name))
    except ValueError:
        return False


def of_tenant(tables: Mapping[str, DataFrame], mappings: dict[str, EntityMapping], name: str, tenant: str | int) -> DataFrame:
    """The entity's rows of one tenant: by its column, which the scan prunes on, or as a semi-join with
    the parent's rows of the tenant."""
    m, base = mappings[name], tables[name]
    if m.tenant_column:
        return base.where(tenant_predicate(base, m.tenant_column, tenant))
    key, parent = tenant_parent(tables, mappings, name)
    ids = of_tenant(tables, mappings, parent, tenant).select(F.col(mappings[parent].physical("id")).alias("_parent_key"))
    return base.join(ids, F.col(key) == F.col("_parent_key"), "left_semi")


def with_tenant(tables: Mapping[str, DataFrame], mappings: dict[str, EntityMapping], name: str) -> tuple[DataFrame, str]:
    """The entity's rows and the name of their tenant column, joined from the parent if need be."""
    m, base = mappings[name], tables[name]
    if m.tenant_column:
        return base, m.tenant_column
    key, parent = tenant_parent(tables, mappings, name)
    rows, tenant = with_tenant(tables, mappings, parent)
    own = rows.select(F.col(mappings[parent].physical("id")).alias("_parent_key"), F.col(tenant).alias("_tenant"))
    return base.join(own, F.col(key) == F.col("_parent_key")).drop("_parent_key"), "_tenant"


def department_ids(tables: Mapping[str, DataFrame], m: EntityMapping) -> DataFrame | None:
    """``(id, name)``, both text, of the departments that the entity's department column points to."""
    if "department" not in m.lookups or not m.physical("department"):
        return None
    entity, id_col, name_col = m.lookups["department"]
    if entity not in tables:
        return None
    return tables[entity].select(F.col(id_col).cast("string").alias("id"), F.col(name_col).alias("name"))


def _name_predicate(name_col: Column, value: str, wildcards: bool) -> Column:
    """Contains, or the ``starts with X`` prefix form (empty remainder stays *contains*)."""
    low = value.lower()
    if low.startswith(STARTS_WITH):
        prefix = low.replace(STARTS_WITH, "", 1).strip()
        if prefix:
            return name_prefix(name_col, prefix, wildcards)
    return name_contains(name_col, value, wildcards)


def _status_value(target: str, word: str, dtype: T.DataType):
    if isinstance(dtype, T.NumericType):
        key = word.strip().lower()
        if key.lstrip("-").isdigit():
            return int(key)
        if key not in STATUS_CODES:
            raise ValueError(f"unknown status word for {target}: {word!r}")
        return STATUS_CODES[key]
    return word


def build_entity_query(tables: Mapping[str, DataFrame], mappings: dict[str, EntityMapping],
                       intent: Intent, tenant: str | int, as_of: dt.datetime,
                       wildcards: bool = False, strict_tenant: bool = False,
                       unknown_date: str = "today") -> EntityQuery:
    target = intent.target()
    m = mappings.get(target)
    if m is None or target not in tables:
        raise ValueError(f"Unsupported target entity: {target}")
    base = of_tenant(tables, mappings, target, tenant)
    f = intent.filters
    ignored: list[str] = []
    warnings: list[str] = []
    conds: list[Column] = []
    first, last = m.physical("firstName"), m.physical("lastName")

    # doctor name: on doctors directly, otherwise EXISTS on doctors by doctor_id
    if f.doctorName:
        if target == "doctors":
            # only the patient-name filter knows the "starts with" form; doctor names always match by contains
            conds.append(name_contains(full_name(F.col(first), F.col(last)), f.doctorName, wildcards))
        elif m.physical("doctor") and "doctors" in tables:
            dm = mappings["doctors"]
            d = tables["doctors"]
            dcond = name_contains(full_name(F.col(dm.physical("firstName")), F.col(dm.physical("lastName"))),
                                  f.doctorName, wildcards)
            if strict_tenant:
                dcond = dcond & tenant_predicate(d, dm.tenant_column, tenant)
            d = d.where(dcond).select(F.col(dm.physical("id")).alias("_doc_key"))
            base = base.join(d, F.col(m.physical("doctor")) == F.col("_doc_key"), "left_semi")
        else:
            ignored.append("doctorName")

    # patient name: on patients directly, or join patients for appointments / prescriptions
    if f.patientName:
        if target == "patients":
            conds.append(_name_predicate(full_name(F.col(first), F.col(last)), f.patientName, wildcards))
        elif target in ("appointments", "prescriptions") and "patients" in tables:
            pm = mappings["patients"]
            p = tables["patients"]
            pcond = _name_predicate(full_name(F.col(pm.physical("firstName")), F.col(pm.physical("lastName"))),
                                    f.patientName, wildcards)
            if strict_tenant:
                pcond = pcond & tenant_predicate(p, pm.tenant_column, tenant)
            # patients.id is unique and only base columns are returned: inner join == semi join
            p = p.where(pcond).select(F.col(pm.physical("id")).alias("_pat_key"))
            base = base.join(p, F.col(m.physical("patient")) == F.col("_pat_key"), "left_semi")
        else:
            ignored.append("patientName")

    if f.status:
        sc = m.physical("status")
        if sc:
            conds.append(F.col(sc) == F.lit(_status_value(target, f.status, base.schema[sc].dataType)))
        else:
            ignored.append("status")

    if f.department:
        dc = m.physical("department")
        known = department_ids(tables, m)
        if known is not None:
            # a word names departments: their ids are the semi-join's build side; an id works as well
            word = f.department.lower()
            known = known.where(F.lower("name").contains(word) | (F.lower("id") == word)).select(
                F.col("id").try_cast(base.schema[dc].dataType).alias("_department"))
            base = base.join(known, F.col(dc) == F.col("_department"), "left_semi")
        elif dc:
            # a word against a numeric id matches nothing (never an error)
            conds.append(F.col(dc) == F.lit(f.department).try_cast(base.schema[dc].dataType))
        else:
            ignored.append("department")

    if f.date:
        date_col = m.physical("scheduledAt") if target == "appointments" else m.physical("createdAt")
        try:
            start, end = resolve_date_range(f.date, as_of, unknown=unknown_date)
            if date_col:
                conds.append(F.col(date_col).between(ts_literal(start), ts_literal(end)))
            else:
                ignored.append("date")
        except InvalidDate as e:
            warnings.append(str(e))

    if f.minExperience is not None:
        ec = m.physical("experience")
        if ec:
            conds.append(F.col(ec) >= F.lit(f.minExperience))
        else:
            ignored.append("minExperience")

    df = base
    for c in conds:
        df = df.where(c)
    if intent.operation == "aggregate":
        df = df.agg(F.count(F.lit(1)).alias("count"))
        return EntityQuery(df, target, True, ignored, warnings)
    idc = m.physical("id")
    df = df.orderBy(F.col(idc)).limit(intent.row_limit())
    return EntityQuery(df, target, False, ignored, warnings)


def entity_query(tables, mappings, intent, tenant, as_of, **kw) -> DataFrame:
    return build_entity_query(tables, mappings, intent, tenant, as_of, **kw).df


def result_count(q: EntityQuery) -> DataFrame:
    """A2: the value of ``count`` for an aggregate, otherwise the number of returned rows."""
    if q.aggregate:
        return q.df.select(F.col("count").alias("results_count"))
    return q.df.agg(F.count(F.lit(1)).alias("results_count"))


def entity_counts(tables, mappings, targets: list[str], tenant, as_of) -> DataFrame:
    """``COUNT(*)`` per requested entity (the reference only counts the first target)."""
    frames = []
    for t in targets:
        q = build_entity_query(tables, mappings, Intent.of("aggregate", [t]), tenant, as_of)
        frames.append(q.df.select(F.lit(t).alias("entity"), F.col("count")))
    out = frames[0]
    for fr in frames[1:]:
        out = out.unionAll(fr)
    return out
