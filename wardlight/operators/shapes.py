"""Declared query shapes (D1-D15): questions from the reference's corpus that its SQL builder
cannot express. Each is a small DataFrame plan; aggregations use partial (map-side) aggregation
and per-group "latest"/"top" use ``max(struct(...))`` instead of a window, so a hot key never
funnels all of its rows into one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.dates import resolve_date_range, ts_literal
from wardlight.operators.entity_query import tenant_predicate


def _between(col: str, keyword: str, as_of: dt.datetime, extended: bool = False):
    start, end = resolve_date_range(keyword, as_of, extended=extended)
    return F.col(col).between(ts_literal(start), ts_literal(end))


def revenue_in_range(appointments: DataFrame, keyword: str, as_of: dt.datetime,
                     extended: bool = True) -> DataFrame:
    """Revenue and appointment count per tenant in a keyword range ("this month")."""
    return (appointments.where(_between("opd_date", keyword, as_of, extended))
            .groupBy("tenant_id")
            .agg(F.round(F.sum("amount"), 2).alias("revenue"), F.count(F.lit(1)).alias("n")))


def top_doctor(appointments: DataFrame) -> DataFrame:
    """D3: per tenant, the doctor with most appointments (ties → lowest doctor id).

    The per-(tenant, doctor) counts are partial-aggregated; the pick is ``max(struct(n, -id))``,
    another partial aggregate, so no window or sort over the raw rows is needed.
    """
    counts = appointments.groupBy("tenant_id", "doctor_id").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("tenant_id").agg(
        F.max(F.struct(F.col("n"), (-F.col("doctor_id")).alias("neg_id"))).alias("b"))
    return best.select("tenant_id", (-F.col("b.neg_id")).alias("doctor_id"),
                       F.col("b.n").alias("n_appointments"))


def latest_per_key(df: DataFrame, key: str, ts: str, id_col: str = "id") -> DataFrame:
    """The newest row per key (ties → highest id) as one partial aggregate."""
    return (df.groupBy(key).agg(F.max(F.struct(F.col(ts), F.col(id_col))).alias("m"))
            .select(key, F.col("m." + id_col).alias(id_col), F.col("m." + ts).alias(ts)))


def last_n(df: DataFrame, ts: str, n: int, id_col: str = "id") -> DataFrame:
    """Newest n rows (TakeOrderedAndProject: per-partition top-n, then a merge of n × parts)."""
    return df.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


def with_event_in_range(parents: DataFrame, events: DataFrame, parent_key: str, event_key: str,
                        ts: str, keyword: str, as_of: dt.datetime) -> DataFrame:
    """Parents having at least one event in the keyword range (left semi join)."""
    # distinct keys: a partial aggregate collapses a busy key map-side before the shuffle
    ev = events.where(_between(ts, keyword, as_of)).select(F.col(event_key).alias("_k")).distinct()
    return parents.join(ev, F.col(parent_key) == F.col("_k"), "left_semi")


def without_event_in_range(parents: DataFrame, events: DataFrame, parent_key: str, event_key: str,
                           ts: str, keyword: str, as_of: dt.datetime) -> DataFrame:
    """D8 complement: parents with no event in the range (left anti join)."""
    ev = events.where(_between(ts, keyword, as_of)).select(F.col(event_key).alias("_k")).distinct()
    return parents.join(ev, F.col(parent_key) == F.col("_k"), "left_anti")


def distinct_per_key(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exact distinct count per key (Spark plans the two-level distinct aggregate)."""
    return df.groupBy(key).agg(F.countDistinct(value).alias(out))


def flagged(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str,
            flag: str) -> DataFrame:
    """Parents with a child row whose flag is set (semi join on the filtered child side)."""
    ch = children.where(F.col(flag) == 1).select(F.col(child_key).alias("_k")).distinct()
    return parents.join(ch, F.col(parent_key) == F.col("_k"), "left_semi")


def most_senior(doctors: DataFrame, by: str = "experience") -> DataFrame:
    """Per tenant, the doctor with the largest ``by`` (ties → lowest id)."""
    best = doctors.groupBy("tenant_id").agg(
        F.max(F.struct(F.col(by), (-F.col("id")).alias("neg_id"))).alias("b"))
    return best.select("tenant_id", (-F.col("b.neg_id")).alias("id"), F.col("b." + by).alias(by))


def at_minute(df: DataFrame, ts: str, minute: dt.datetime) -> DataFrame:
    """Rows whose time falls in the given minute (range predicate, pushable to the scan)."""
    start = minute.replace(second=0, microsecond=0)
    end = start + dt.timedelta(minutes=1)
    return df.where((F.col(ts) >= ts_literal(start)) & (F.col(ts) < ts_literal(end)))


def rank_within(df: DataFrame, key: str, order_cols, n: int) -> DataFrame:
    """Top-n rows per key; Spark inserts a partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def tenant_rows(df: DataFrame, tenant: str, col: str = "tenant_id") -> DataFrame:
    return df.where(tenant_predicate(df, col, tenant))
