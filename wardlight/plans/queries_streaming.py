"""Registered stream-vs-batch queries: each drains a Structured Streaming job (availableNow) over
the driver table file and reads its sink back; the oracle is the batch SQL of the same job."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlight.operators.ingest import point_store
from wardlight.plans import queries_log
from wardlight.plans.queries_ingest import NEWEST_OF_ALL_SQL, _changed_batch, passages_sql
from wardlight.plans.oracle_views import with_views
from wardlight.plans.registry import ORACLE, register
from wardlight.session import scratch_path
from wardlight.sources.tables import DRIVER_MAPPINGS, Catalog
from wardlight.streaming.jobs import drain, ingest_stream, rate_limit_stream, run_to_table, \
    session_history_stream, table_stream


def _in_parts(spark, parts, folder, run):
    """Each part written below ``folder``, in as many files as it has, and what is new given to ``run`` as
    a stream: with one checkpoint and ``availableNow`` every part is a micro-batch of its own."""
    for n, rows in enumerate(parts):
        rows.write.parquet(f"{folder}/{n}")
        run(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(folder))


@register("rate_limit_stream", ORACLE["rate_limit"])
def q_rate_limit_stream(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    src = table_stream(spark, sf_dir, "events", cat.raw("events").schema)
    out = scratch_path(spark, "rate-limit-stream")
    run_to_table(rate_limit_stream(Catalog.bind_requests(src), queries_log.DAY_US, 3),
                 out + "/data", out + "/_checkpoint")
    return spark.read.parquet(out + "/data")


_LATE_DAYS, _LATE_MAX = 2, 2
_PART = ("CASE WHEN event_id % 5 = 0 THEN 2 WHEN {day} % 2 = 1 THEN 0 ELSE 1 END")


@register("rate_limit_stream_late", f"""WITH RECURSIVE o AS (
    SELECT event_id, user_id AS key, ts, epoch_us(ts) AS us,
           row_number() OVER (PARTITION BY user_id ORDER BY {_PART.format(day='day(ts)')}, epoch_us(ts), event_id) AS rn FROM events),
  r AS (SELECT event_id, key, ts, rn, true AS accepted, [us] AS kept, us AS newest FROM o WHERE rn = 1
        UNION ALL
        SELECT event_id, key, ts, rn, fits, CASE WHEN fits THEN with_it ELSE kept END, newest FROM (
          SELECT *, us >= newest - {_LATE_DAYS * queries_log.DAY_US} AND len(list_filter(generate_series(1, len(with_it) - {_LATE_MAX}),
                     lambda j: with_it[j + {_LATE_MAX}] - with_it[j] < {queries_log.DAY_US})) = 0 AS fits FROM (
            SELECT o.event_id, o.key, o.ts, o.rn, o.us, r.kept, greatest(r.newest, o.us) AS newest, list_sort(list_append(r.kept, o.us)) AS with_it
            FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1)))
  SELECT event_id, key, ts, accepted FROM r""")
def q_rate_limit_stream_late(spark, sf_dir):
    """The events in three parts, one a micro-batch: odd days, even days, then every fifth event."""
    cat, out = Catalog(spark, sf_dir), scratch_path(spark, "rate-limit-late")
    events = cat.raw("events")
    _in_parts(spark, [events.where(F.expr(_PART.format(day="day(ts)")) == n) for n in range(3)], out + "/events", lambda src: run_to_table(
        rate_limit_stream(Catalog.bind_requests(src), queries_log.DAY_US, _LATE_MAX, lateness_us=_LATE_DAYS * queries_log.DAY_US),
        out + "/data", out + "/_checkpoint"))
    return spark.read.parquet(out + "/data")


@register("session_history_stream", ORACLE["session_history"])
def q_session_history_stream(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    src = table_stream(spark, sf_dir, "conversations", cat.raw("conversations").schema)
    out = scratch_path(spark, "history-stream")
    run_to_table(session_history_stream(Catalog.bind_messages(src), 3), out + "/data",
                 out + "/_checkpoint", output_mode="update")
    emitted = spark.read.parquet(out + "/data")
    w = Window.partitionBy("session_id").orderBy(F.col("_epoch").desc())
    return (emitted.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("session_id", "history"))


@register("ingest_stream", with_views("appointments") +
          passages_sql("appointments", "appointments", DRIVER_MAPPINGS["appointments"]))
def q_ingest_stream(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    src = table_stream(spark, sf_dir, "orders", cat.raw("orders").schema)
    out = scratch_path(spark, "ingest-stream")
    q = ingest_stream(Catalog.bind_appointments(src), DRIVER_MAPPINGS["appointments"], out + "/store",
                      out + "/_checkpoint")
    drain(q)
    return point_store(spark, out + "/store").read()


@register("ingest_stream_late", NEWEST_OF_ALL_SQL)
def q_ingest_stream_late(spark, sf_dir):
    """Two parts, one a micro-batch: the changed appointments arrive before the rows they change."""
    cat, m = Catalog(spark, sf_dir), DRIVER_MAPPINGS["appointments"]
    out = scratch_path(spark, "ingest-late")
    _in_parts(spark, (_changed_batch(cat), cat.appointments()), out + "/rows",
              lambda src: drain(ingest_stream(src, m, out + "/store", out + "/_checkpoint")))
    return point_store(spark, out + "/store").read()
