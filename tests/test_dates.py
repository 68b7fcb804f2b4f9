"""Date keyword resolver: driver form edge rows, and column form == driver form."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardlight.functions.dates import InvalidDate, resolve_date_columns, resolve_date_range

MS = dt.timedelta(milliseconds=1)


def day(y, m, d):
    return dt.datetime(y, m, d)


@pytest.mark.parametrize("kw,as_of,start", [
    ("today", day(2024, 3, 15), day(2024, 3, 15)),
    ("Yesterday", day(2024, 3, 1), day(2024, 2, 29)),
    ("tomorrow", day(2024, 2, 28), day(2024, 2, 29)),
    ("show last week please", day(2024, 3, 17), day(2024, 3, 10)),   # Sunday as_of
    ("last week", day(2024, 3, 16), day(2024, 3, 3)),                # Saturday as_of
    ("last month", day(2024, 1, 10), day(2023, 12, 1)),              # across a year end
    ("last month", day(2024, 3, 31), day(2024, 2, 1)),
    ("2024-02-29", day(2020, 1, 1), day(2024, 2, 29)),
    ("2024-02-31", day(2020, 1, 1), day(2024, 3, 2)),                # JS Date roll-over
    ("this month", day(2024, 3, 15), day(2024, 3, 15)),              # unknown word → today
    ("", day(2024, 3, 15), day(2024, 3, 15)),
])
def test_driver_resolver(kw, as_of, start):
    s, e = resolve_date_range(kw, as_of)
    assert s == start
    if "week" in kw.lower() and "last" in kw.lower():
        assert e == s + dt.timedelta(days=7) - MS
    elif "month" in kw.lower() and "last" in kw.lower():
        nxt = (s.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        assert e == nxt - MS
    else:
        assert e == s + dt.timedelta(days=1) - MS


def test_embedded_iso_is_invalid_and_extended_words():
    with pytest.raises(InvalidDate):
        resolve_date_range("on 2024-02-10", day(2024, 3, 1))
    s, e = resolve_date_range("this month", day(2024, 3, 15), extended=True)
    assert s == day(2024, 3, 1) and e == day(2024, 4, 1) - MS
    with pytest.raises(InvalidDate):
        resolve_date_range("fortnight", day(2024, 3, 15), unknown="error")


def test_column_form_matches_driver_form(spark):
    kws = ["today", "yesterday", "last week", "LAST MONTH", "tomorrow", "2023-12-31", "2023-02-30",
           "on 2024-01-01", "this month", "", None]
    days = [day(2023, 12, 31) + dt.timedelta(days=i) for i in range(0, 70, 3)]
    rows = [(k, d.strftime("%Y-%m-%d 00:00:00")) for k in kws for d in days]
    df = spark.createDataFrame(rows, "kw string, now string").withColumn("now", F.col("now").cast("timestamp_ntz"))
    s, e = resolve_date_columns(F.col("kw"), F.col("now"))
    got = df.select("kw", "now", s.alias("s"), e.alias("e")).collect()
    for r in got:
        try:
            want = resolve_date_range(r["kw"], r["now"])
        except InvalidDate:
            want = (None, None)
        assert (r["s"], r["e"]) == want, (r["kw"], r["now"])


def test_column_form_matches_driver_form_on_random_cases(spark):
    import random
    rnd = random.Random(7)
    words = ["today", "Yesterday", "LAST WEEK", "last month", "tomorrow", "this month", "next year", ""]
    rows = []
    for _ in range(600):
        now = dt.datetime(1995, 1, 1) + dt.timedelta(days=rnd.randrange(0, 365 * 30))
        if rnd.random() < 0.5:
            kw = rnd.choice(words)
        else:
            y, m, d = rnd.randrange(1990, 2031), rnd.randrange(0, 14), rnd.randrange(0, 33)
            iso = f"{y:04d}-{m:02d}-{d:02d}"
            kw = iso if rnd.random() < 0.8 else f"on {iso}"
        rows.append((kw, now.strftime("%Y-%m-%d 00:00:00")))
    df = spark.createDataFrame(rows, "kw string, now string").withColumn("now", F.col("now").cast("timestamp_ntz"))
    s, e = resolve_date_columns(F.col("kw"), F.col("now"))
    for r in df.select("kw", "now", s.alias("s"), e.alias("e")).collect():
        try:
            want = resolve_date_range(r["kw"], r["now"])
        except InvalidDate:
            want = (None, None)
        assert (r["s"], r["e"]) == want, (r["kw"], r["now"])
