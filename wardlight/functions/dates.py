"""Date keyword → inclusive ``[start, end]`` range.

Two forms with one rule set:

* ``resolve_date_range(keyword, as_of)`` runs on the driver and yields literals for a filter, so
  Catalyst sees constants (constant folding, parquet min/max pruning on the date column).
* ``resolve_date_columns(keyword_col, now_col)`` is the same rule as column expressions, for a
  table of keywords (each row may carry its own "now").

Rule (first match wins, on the lower-cased keyword): ``today`` → that day; ``yesterday`` → day
before; ``week`` and ``last`` → previous Sunday-to-Saturday week; ``month`` and ``last`` → previous
calendar month; ``tomorrow`` → next day; a ``YYYY-MM-DD`` that *is* the keyword → that day, with
JavaScript ``Date`` roll-over (``2024-02-31`` is 2 March); a ``YYYY-MM-DD`` embedded in other text →
invalid (no range, the filter is dropped); anything else → today (``unknown="today"``) or an error.
``extended=True`` adds ``this week`` / ``this month``. End = start of the next unit minus 1 ms.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_ANYWHERE = re.compile(r"\d{4}-\d{2}-\d{2}")
ISO_EXACT = re.compile(r"^(\d{4})-(\d{2})-(\d{2})$")
_ONE_MS = dt.timedelta(milliseconds=1)


class InvalidDate(ValueError):
    pass


def _add_months(d: dt.date, n: int) -> dt.date:
    y, m = divmod(d.month - 1 + n, 12)
    return dt.date(d.year + y, m + 1, 1)


def _sunday_start(d: dt.date) -> dt.date:
    # Python weekday: Monday=0 … Sunday=6
    return d - dt.timedelta(days=(d.weekday() + 1) % 7)


def _js_rollover(y: int, m: int, d: int) -> dt.date:
    base = _add_months(dt.date(y, 1, 1), m - 1)
    return base + dt.timedelta(days=d - 1)


def resolve_date_range(keyword: str | None, as_of: dt.datetime | dt.date,
                       unknown: str = "today", extended: bool = False
                       ) -> tuple[dt.datetime, dt.datetime]:
    """Driver-side resolver. Raises ``InvalidDate`` for an embedded or impossible ISO date."""
    today = as_of.date() if isinstance(as_of, dt.datetime) else as_of
    start, end_excl = today, today + dt.timedelta(days=1)
    if keyword:
        k = keyword.lower()
        if "today" in k:
            pass
        elif "yesterday" in k:
            start = today - dt.timedelta(days=1)
            end_excl = today
        elif "week" in k and "last" in k:
            start = _sunday_start(today - dt.timedelta(days=7))
            end_excl = start + dt.timedelta(days=7)
        elif "month" in k and "last" in k:
            start = _add_months(today, -1)
            end_excl = _add_months(start, 1)
        elif "tomorrow" in k:
            start = today + dt.timedelta(days=1)
            end_excl = start + dt.timedelta(days=1)
        elif ISO_ANYWHERE.search(k):
            m = ISO_EXACT.match(k)
            if not m:
                raise InvalidDate(f"Invalid date format: {keyword}")
            try:
                start = _js_rollover(int(m.group(1)), int(m.group(2)), int(m.group(3)))
            except (ValueError, OverflowError) as e:
                raise InvalidDate(f"Invalid date format: {keyword}") from e
            end_excl = start + dt.timedelta(days=1)
        elif extended and "week" in k and "this" in k:
            start = _sunday_start(today)
            end_excl = start + dt.timedelta(days=7)
        elif extended and "month" in k and "this" in k:
            start = today.replace(day=1)
            end_excl = _add_months(start, 1)
        elif unknown == "error":
            raise InvalidDate(f"Unknown date keyword: {keyword}")
    return (dt.datetime.combine(start, dt.time()),
            dt.datetime.combine(end_excl, dt.time()) - _ONE_MS)


def ts_literal(value: dt.datetime | str) -> Column:
    """A ``timestamp_ntz`` literal, independent of the session time zone."""
    s = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(s).cast("timestamp_ntz")


def _sunday_start_col(d: Column) -> Column:
    return F.date_sub(d, F.dayofweek(d) - 1)  # Spark: Sunday = 1


def resolve_date_columns(keyword: Column, now: Column, unknown: str = "today",
                         extended: bool = False) -> tuple[Column, Column]:
    """Column form of the same rule: returns ``(start, end)`` timestamp_ntz columns.

    Invalid ISO keywords give null bounds (the caller drops the filter / flags the row).
    """
    k = F.lower(keyword)
    today = F.to_date(now)
    iso_y = F.regexp_extract(k, r"^(\d{4})-(\d{2})-(\d{2})$", 1)
    iso_m = F.regexp_extract(k, r"^(\d{4})-(\d{2})-(\d{2})$", 2).cast("int")
    iso_d = F.regexp_extract(k, r"^(\d{4})-(\d{2})-(\d{2})$", 3).cast("int")
    iso_day = F.date_add(F.add_months(F.try_to_date(F.concat(iso_y, F.lit("-01-01"))), iso_m - 1),
                         iso_d - 1)
    last_week = _sunday_start_col(F.date_sub(today, 7))
    last_month = F.trunc(F.add_months(today, -1), "MM")
    start = (F.when(keyword.isNull() | (keyword == ""), today)
             .when(k.contains("today"), today)
             .when(k.contains("yesterday"), F.date_sub(today, 1))
             .when(k.contains("week") & k.contains("last"), last_week)
             .when(k.contains("month") & k.contains("last"), last_month)
             .when(k.contains("tomorrow"), F.date_add(today, 1))
             .when(k.rlike(r"\d{4}-\d{2}-\d{2}"),
                   F.when(k.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso_day)))
    end_excl = (F.when(keyword.isNull() | (keyword == ""), F.date_add(today, 1))
                .when(k.contains("today"), F.date_add(today, 1))
                .when(k.contains("yesterday"), today)
                .when(k.contains("week") & k.contains("last"), F.date_add(last_week, 7))
                .when(k.contains("month") & k.contains("last"), F.add_months(last_month, 1))
                .when(k.contains("tomorrow"), F.date_add(today, 2))
                .when(k.rlike(r"\d{4}-\d{2}-\d{2}"),
                      F.when(k.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_add(iso_day, 1))))
    if extended:
        this_week = _sunday_start_col(today)
        this_month = F.trunc(today, "MM")
        start = (start.when(k.contains("week") & k.contains("this"), this_week)
                 .when(k.contains("month") & k.contains("this"), this_month))
        end_excl = (end_excl.when(k.contains("week") & k.contains("this"), F.date_add(this_week, 7))
                    .when(k.contains("month") & k.contains("this"), F.add_months(this_month, 1)))
    if unknown == "today":
        start = start.otherwise(today)
        end_excl = end_excl.otherwise(F.date_add(today, 1))
    start_ts = start.cast("timestamp_ntz")
    end_ts = end_excl.cast("timestamp_ntz") - F.expr("INTERVAL 1 MILLISECOND")
    return start_ts, end_ts
