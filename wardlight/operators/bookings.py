"""Batch booking-request resolution (B1 with J5, F5, T4, X17, S10).

Each request names a patient and a doctor by a fragment; the reference picks the first row whose
first *or* last name contains the fragment (case-insensitive) within the request's tenant.

A ``contains`` join condition would plan as a nested-loop join. Instead the needles find the names by
their rarest trigram (``name_match``), and the smallest id per (tenant, needle) is a partial aggregate.
Requests then equi-join that index on (tenant, needle): no pairs of requests and people, and a hot
needle shared by many requests is just a skewed equi-join key that AQE splits. Every request gets one
row of one resolution; accepted and rejected bookings are two filters of it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.dates import ts_literal
from wardlight.functions.text import js_trim
from wardlight.operators.name_match import containing
from wardlight.session import checkpoint_root

REASON_PATIENT = "patient_not_found"
REASON_DOCTOR = "doctor_not_found"
REASON_BOTH = "patient_and_doctor_not_found"
REASON_DATE = "invalid_date"


def _norm_needle(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.lower(c))


def first_match(needles: DataFrame, people: DataFrame, name_cols: tuple[str, ...] = ("first_name", "last_name"),
                id_col: str = "id", tenant_col: str = "tenant_id") -> DataFrame:
    """``(tenant, needle, match_id)``: the smallest id of a tenant any of whose names contains the
    lower-cased ``needle`` (J5, T4). Names that people share are one before they are compared."""
    names = None
    for c in name_cols:
        own = people.select(F.col(tenant_col).cast("string").alias("scope"), F.lower(F.col(c)).alias("name"), F.col(id_col).alias("id"))
        names = own if names is None else names.unionByName(own)
    names = names.where("name is not null").groupBy("scope", "name").agg(F.min("id").alias("id"))
    return (containing(needles, names).groupBy(F.col("scope").alias("tenant"), "needle").agg(F.min("id").alias("match_id")))


def resolution(requests: DataFrame, patients: DataFrame, doctors: DataFrame, as_of: dt.datetime, *,
               zero_id_is_missing: bool = True) -> DataFrame:
    """``requests(request_id, tenant_id, patient_name, doctor_name, date)`` → one row each: request_id,
    tenant_id, patient_id, doctor_id, scheduled_at, and the reason of a rejection, null if accepted."""
    r = requests.select("request_id", F.col("tenant_id").cast("string").alias("tenant_id"),
                        _norm_needle(F.col("patient_name")).alias("pn"),
                        _norm_needle(F.col("doctor_name")).alias("dn"),
                        js_trim(F.col("date")).alias("date"))
    # a missing needle gets a key of its own that no name has, so such requests share no partition
    own = F.concat(F.lit("\x00"), F.col("request_id").cast("string"))
    j = r
    for needle, people, found in (("pn", patients, "patient_id"), ("dn", doctors, "doctor_id")):
        index = first_match(r.select(F.col("tenant_id").alias("scope"), F.col(needle).alias("needle")), people)
        j = j.join(index.select(F.col("tenant").alias("_t"), F.col("needle").alias("_n"), F.col("match_id").alias(found)),
                   (F.col("tenant_id") == F.col("_t")) & (F.coalesce(needle, own) == F.col("_n")), "left").drop("_t", "_n")
    p_ok = F.col("patient_id").isNotNull()
    d_ok = F.col("doctor_id").isNotNull()
    if zero_id_is_missing:
        p_ok = p_ok & (F.col("patient_id") != 0)
        d_ok = d_ok & (F.col("doctor_id") != 0)
    has_date = F.col("date").isNotNull() & (F.col("date") != "")
    parsed = F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    when_ts = F.when(has_date, parsed).otherwise(ts_literal(as_of + dt.timedelta(days=1)))
    reason = (F.when(~p_ok & ~d_ok, F.lit(REASON_BOTH)).when(~p_ok, F.lit(REASON_PATIENT)).when(~d_ok, F.lit(REASON_DOCTOR))
              .when(has_date & parsed.isNull(), F.lit(REASON_DATE)))
    return j.select("request_id", "tenant_id", "patient_id", "doctor_id", when_ts.alias("scheduled_at"), reason.alias("reason"))


def _accepted(resolved: DataFrame) -> DataFrame:
    return resolved.where("reason is null").drop("reason").withColumn("status", F.lit(0))


def _rejected(resolved: DataFrame) -> DataFrame:
    return resolved.where("reason is not null").select("request_id", "tenant_id", "reason")


def resolve_bookings(requests: DataFrame, patients: DataFrame, doctors: DataFrame,
                     as_of: dt.datetime, *, zero_id_is_missing: bool = True
                     ) -> tuple[DataFrame, DataFrame]:
    """``requests(request_id, tenant_id, patient_name, doctor_name, date)`` →
    ``(accepted, rejected)``.

    accepted: ``request_id, tenant_id, patient_id, doctor_id, scheduled_at, status`` (status 0,
    time = the request date at midnight, else ``as_of`` + 1 day). rejected: ``request_id,
    tenant_id, reason``. ``zero_id_is_missing`` keeps the reference's truthiness test (an id of 0
    counts as not found).
    """
    resolved = resolution(requests, patients, doctors, as_of, zero_id_is_missing=zero_id_is_missing)
    return _accepted(resolved), _rejected(resolved)


def append_appointments(accepted: DataFrame, path: str) -> None:
    """Accepted bookings appended to the appointments sink; the files follow the bytes, not the
    tasks (AQE joins small partitions and splits large ones)."""
    accepted.hint("rebalance").write.mode("append").parquet(path)


def book(requests: DataFrame, patients: DataFrame, doctors: DataFrame, as_of: dt.datetime, path: str, **kw) -> DataFrame:
    """Appends the accepted bookings to ``path`` and returns the rejected ones, from one resolution."""
    checkpoint_root(requests.sparkSession)
    resolved = resolution(requests, patients, doctors, as_of, **kw).checkpoint()
    append_appointments(_accepted(resolved), path)
    return _rejected(resolved)
