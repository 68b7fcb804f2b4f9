"""Request windows (W2) and the exact sliding-window rate limiter (L1).

W2 — requests by the same key in ``(ts - window, ts]`` — is a RANGE-frame count. To keep a hot key
from becoming one giant window partition, rows are bucketed by time (bucket width >= window) and
each row is also copied into the next bucket as a *halo*: every window then lies inside one
(key, bucket) partition, the count is exact, and only the row's own copy is emitted.

L1 is path-dependent (rejected requests are not recorded), but only where a key is busy: while the
requests of a window, accepted or not, are no more than ``max_requests``, each is accepted whatever
came before. So requests are first counted per key and eighth of a window, a small table; spans where
nine eighths hold more than the limit are *contended*. All other requests are accepted by a plain join
on the JVM. A contended span, with the window before it, is decided in order: hash-partition by key and
span, sort by time, and ``mapInPandas`` streams each partition with a ring of at most ``max_requests``
accepted stamps, so memory is bounded by ``max_requests``. Spans of one key are independent, as the
window before a span holds sure acceptances only. Accept iff fewer than ``max_requests`` accepted
stamps lie in ``(ts - window, ts]``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.session import checkpoint_root

# Default limiter window (60 s) and request budget per window.
DEFAULT_WINDOW_US = 60_000 * 1000  # 60 s
DEFAULT_MAX = 100


def epoch_micros(name: str):
    """Microseconds since 1970-01-01 of the wall-clock time in column ``name``, independent of
    the session time zone (a cast to a zoned timestamp would bend differences across
    daylight-saving changes)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                  f"CAST(`{name}` AS TIMESTAMP_NTZ))")


def _micros(ts: str):
    return epoch_micros(ts)


HOT_WINDOW_ROWS = 2_000_000


def requests_in_window(events: DataFrame, window_us: int, key: str = "key", ts: str = "ts",
                       id_col: str = "event_id", bucket_us: int | None = None,
                       hot_window_rows: int | None = HOT_WINDOW_ROWS) -> DataFrame:
    """``(id, key, ts, n_in_window)`` with n = rows of the key whose time is in (ts - w, ts].

    Skew-adaptive: one partial aggregate finds the busiest (key, window-bucket); below
    ``hot_window_rows`` the halo-bucket window runs, above it (or with ``None``) the prefix-count
    form, which never puts one key's window into one task.
    """
    base = events.select(F.col(id_col).alias("_id"), F.col(key).alias("_key"), F.col(ts).alias("_ts"),
                         _micros(ts).alias("_us"))
    prefix = hot_window_rows is None
    if not prefix:
        busiest = (base.groupBy("_key", F.floor(F.col("_us") / F.lit(window_us)).alias("_b"))
                   .agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0)
        prefix = busiest > hot_window_rows
    timed, untimed = base.where("_us is not null"), base.where("_us is null")
    out = _window_counts_prefix(timed, window_us) if prefix else _window_counts_halo(timed, window_us, bucket_us)
    # a request without a time is in no window
    out = out.unionByName(untimed.select("_id", "_key", "_ts", F.lit(None).cast("bigint").alias("n_in_window")))
    return out.select(F.col("_id").alias(id_col), F.col("_key").alias(key), F.col("_ts").alias(ts),
                      "n_in_window")


def _window_counts_halo(base: DataFrame, window_us: int, bucket_us: int | None) -> DataFrame:
    b = max(bucket_us or window_us, window_us)
    base = base.withColumn("_bucket", F.floor(F.col("_us") / F.lit(b)).cast("bigint"))
    own = base.withColumn("_own", F.lit(True))
    halo = base.withColumn("_bucket", F.col("_bucket") + 1).withColumn("_own", F.lit(False))
    both = own.unionByName(halo)
    w = (Window.partitionBy("_key", "_bucket").orderBy("_us")
         .rangeBetween(-(window_us - 1), Window.currentRow))
    counted = both.withColumn("n_in_window", F.count(F.lit(1)).over(w))
    return counted.where(F.col("_own")).select("_id", "_key", "_ts", "n_in_window")


def _window_counts_prefix(base: DataFrame, window_us: int) -> DataFrame:
    """n = C(t) - C(t - w), C = the key's running count of requests at or before a time.

    Every request contributes 1 at its time; two zero-weight probes per request sit at t and t - w,
    ordered after the requests of the same instant, so the running sum at a probe is C at that
    time. The running sum is the skew-proof ``running_sum_within``; probes are paired back by a
    partial aggregate on the request id.
    """
    from wardlight.functions.numbering import running_sum_within
    checkpoint_root(base.sparkSession)
    # rows are told apart by a number of their own: request ids may repeat or be null
    base = base.withColumn("_rid", F.monotonically_increasing_id()).checkpoint()
    reals = base.select("_key", F.col("_us").alias("_t"), F.lit(0).alias("_kind"), "_rid",
                        F.lit("").alias("_role"), F.lit(1).alias("_v"))
    upper = base.select("_key", F.col("_us").alias("_t"), F.lit(1).alias("_kind"), "_rid",
                        F.lit("u").alias("_role"), F.lit(0).alias("_v"))
    lower = base.select("_key", (F.col("_us") - F.lit(window_us)).alias("_t"), F.lit(1).alias("_kind"), "_rid",
                        F.lit("l").alias("_role"), F.lit(0).alias("_v"))
    c = running_sum_within(reals.unionByName(upper).unionByName(lower), "_key",
                           ["_t", "_kind", "_rid", "_role"], "_v", "_c")
    probes = (c.where(F.col("_kind") == 1).groupBy("_rid")
              .agg((F.max(F.when(F.col("_role") == "u", F.col("_c")))
                    - F.max(F.when(F.col("_role") == "l", F.col("_c")))).alias("n_in_window")))
    return base.join(probes, "_rid", "inner").select("_id", "_key", "_ts",
                                                    F.col("n_in_window").cast("bigint").alias("n_in_window"))


def _limiter(window_us: int, max_requests: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur = None
        ring: deque = deque()
        for b in batches:
            keys = b["key"]
            codes = b["_k"].to_numpy()
            segs = b["_seg"].to_numpy()
            us = b["_us"].to_numpy(dtype=np.int64)
            acc = np.zeros(len(b), dtype=bool)
            for i in range(len(b)):
                k = (codes[i], segs[i])
                if k != cur:          # a new key, or a new independent segment of the same key
                    cur, ring = k, deque()
                t = us[i]
                while ring and ring[0] <= t - window_us:
                    ring.popleft()
                if len(ring) < max_requests:
                    ring.append(t)
                    acc[i] = True
            yield pd.DataFrame({"event_id": b["event_id"], "key": keys, "ts": b["ts"],
                                "accepted": acc})
    return run


PIECES = 8    # a window is counted in so many parts


def contended_spans(df: DataFrame, window_us: int, max_requests: int) -> DataFrame:
    """``(_key, _piece, _seg)``: the parts of time in which a key's requests (``key``, ``_us``) must be
    decided in order, and the span each belongs to.

    A part is contended when it and the PIECES before it, which cover every window that ends in it, hold
    more than ``max_requests``; so are the PIECES parts before it, whose requests fill its windows. A span
    ends where the next part lies more than PIECES later, or is not contended.
    """
    piece = F.floor(F.col("_us") / F.lit(_piece_us(window_us))).cast("bigint")
    counts = df.groupBy(F.col("key").alias("_key"), piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_key").orderBy("_piece")
    busy = counts.withColumn("_busy", F.sum("_n").over(order.rangeBetween(-PIECES, 0)) > max_requests)
    near = busy.withColumn("_near", F.coalesce(F.max("_busy").over(order.rangeBetween(0, PIECES)), F.lit(False)))
    before = near.withColumns({"_last": F.lag("_piece").over(order), "_last_near": F.lag("_near").over(order)})
    starts = F.col("_last").isNull() | ~F.col("_last_near") | (F.col("_piece") - F.col("_last") > PIECES)
    spans = before.withColumn("_seg", F.max(F.when(starts, F.col("_piece"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.where("_near").select("_key", "_piece", "_seg")


def _piece_us(window_us: int) -> int:
    return -(-window_us // PIECES)


def rate_limit(events: DataFrame, window_us: int = DEFAULT_WINDOW_US, max_requests: int = DEFAULT_MAX,
               key: str = "key", ts: str = "ts", id_col: str = "event_id", num_partitions: int | None = None) -> DataFrame:
    """L1 in batch: ``(event_id, key, ts, accepted)`` for every request (ties ordered by id).

    The contended spans are written once; without any, the plan has no sequential part at all.
    """
    checkpoint_root(events.sparkSession)
    df = events.select(F.col(id_col).alias("event_id"), F.col(key).alias("key"),
                       F.col(ts).cast("timestamp_ntz").alias("ts"), _micros(ts).alias("_us"))
    spans = contended_spans(df.where("_us is not null"), window_us, max_requests).checkpoint()
    if spans.isEmpty():
        # a request without a time has no window: it is rejected, and recorded nowhere
        return df.select("event_id", "key", "ts", F.col("_us").isNotNull().alias("accepted"))
    df = df.withColumn("_piece", F.floor(F.col("_us") / F.lit(_piece_us(window_us))).cast("bigint"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (df["_piece"] == spans["_piece"])
    sure = df.join(spans, same, "left_anti").select("event_id", "key", "ts", F.col("_us").isNotNull().alias("accepted"))
    parts = [num_partitions] if num_partitions else []
    rest = (df.join(spans, same).select("event_id", "key", "ts", "_us", "_seg")
            .repartition(*parts, "key", "_seg").sortWithinPartitions("key", "_seg", "_us", "event_id"))
    rest = rest.withColumn("_k", F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")))
    out = T.StructType([df.schema["event_id"], df.schema["key"], T.StructField("ts", T.TimestampNTZType()),
                        T.StructField("accepted", T.BooleanType())])
    return sure.unionByName(rest.mapInPandas(_limiter(window_us, max_requests), out))
