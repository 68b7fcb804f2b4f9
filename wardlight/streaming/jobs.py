"""Structured Streaming forms: incremental ingest (ST1), exact rate limiting (ST2) and rolling
session history (ST3).

* ST1: ``readStream`` of a table folder → passages → ``foreachBatch`` merge into the point store. The
  stream checkpoint replaces the JSON high-water file; the store knows each stream's last epoch, so
  recovery after a lost executor or driver is idempotent, and files may come in any order.
* ST2: ``applyInPandasWithState`` keyed by request key. State = the accepted stamps of the last window
  and the allowed lateness, sorted, so its size never grows with a key's history. Within a micro-batch a
  key's rows are sorted by (time, id); across micro-batches the result equals the batch limiter when
  each key's requests arrive in time order. A late request is held against the windows on both sides
  of it, so no window ever exceeds the limit, and gets its one output row.
* ST3: ``applyInPandasWithState`` keyed by session; state = the last ``n`` messages; each
  micro-batch emits the updated history of the sessions it touched.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from wardlight.operators.ingest import Embedder, embed_all, point_store, split_embedded, vector_cache
from wardlight.operators.passages import build_passages
from wardlight.operators.ratelimit import epoch_micros
from wardlight.operators.sessions import OTHER_LABEL, USER_LABEL
from wardlight.session import checkpoint_root
from wardlight.sources.mapping import EntityMapping


def table_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``<folder>/<table>*.parquet``: files, or folders of part files of any name."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(f"{folder.rstrip('/')}/{table}*.parquet")


# ---------------------------------------------------------------------------------------------
# ST1
# ---------------------------------------------------------------------------------------------

def ingest_stream(rows: DataFrame, mapping: EntityMapping, store_root: str, checkpoint: str,
                  embedders: Embedder | list[Embedder] | None = None, tenant_arg: str | None = None,
                  available_now: bool = True, cache_root: str | None = None):
    """Start the streaming ingest; returns the ``StreamingQuery``.

    Each micro-batch: passages → (optional) embeddings → a delta of the point store. The newest version
    of a point wins whatever micro-batch or batch run brings it. Without embedders the store holds
    passages only (text search / later embedding). The store's manifest keeps each stream's last epoch
    beside the rows and the quarantine, so a replayed micro-batch changes nothing.
    """
    passages = build_passages(rows, mapping, tenant_arg)
    stream_id = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        pts, quarantine = batch, None
        if embedders is not None:
            # embed once: points and quarantine both read the materialised result
            checkpoint_root(spark)
            cache = vector_cache(spark, cache_root) if cache_root else None
            pts, quarantine = split_embedded(embed_all(batch, embedders, cache=cache).checkpoint(eager=True))
        point_store(spark, store_root).merge(pts, failed=quarantine, stream=(stream_id, epoch))

    w = passages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


# ---------------------------------------------------------------------------------------------
# ST2
# ---------------------------------------------------------------------------------------------

RL_STATE = T.StructType([T.StructField("stamps", T.ArrayType(T.LongType())), T.StructField("newest", T.LongType())])


def _fits(stamps: list[int], at: int, t: int, window_us: int, most: int) -> bool:
    """Whether no window holds more than ``most`` stamps once t stands at place ``at`` of the sorted
    ``stamps``: of any ``most`` + 1 that follow each other, t among them, the ends are a window apart."""
    if most <= 0:
        return False
    for first in range(max(0, at - most), at + 1):
        last = first + most                       # places in the list with t
        if last > len(stamps):
            break
        begin = stamps[first] if first < at else t
        end = t if last == at else stamps[last - 1]
        if end - begin < window_us:
            return False
    return True


def _in_order(batch: pd.DataFrame) -> pd.DataFrame:
    """Requests by time, then id. Ids are looked at only if times repeat or are missing: for the few rows
    of a key a sort by two columns costs more than all else."""
    us = batch["_us"].to_numpy()
    order = np.argsort(us, kind="stable")
    later = np.diff(us[order]) > 0 if us.dtype.kind in "iuf" else np.zeros(1, bool)
    return batch.take(order) if later.all() else batch.sort_values(["_us", "event_id"], kind="stable")


def _rl_state_fn(window_us: int, max_requests: int, lateness_us: int, idle_ms: int | None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        stamps, newest = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        batch = _in_order(pd.concat(list(pdfs), ignore_index=True))
        acc = []
        for t in batch["_us"]:
            if pd.isna(t):                        # a request without a time has no window
                acc.append(False)
                continue
            t = int(t)
            newest = t if newest is None else max(newest, t)
            at = bisect_right(stamps, t)
            good = t >= newest - lateness_us and _fits(stamps, at, t, window_us, max_requests)
            if good:
                stamps.insert(at, t)
            acc.append(good)
        if newest is not None:
            stamps = stamps[bisect_right(stamps, newest - lateness_us - window_us):]
        state.update((stamps, newest))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"event_id": batch["event_id"].to_numpy(), "key": batch["key"].to_numpy(),
                            "ts": batch["ts"].to_numpy(), "accepted": acc})
    return fn


def rate_limit_stream(requests: DataFrame, window_us: int, max_requests: int, idle_ms: int | None = None,
                      lateness_us: int | None = None) -> DataFrame:
    """Streaming L1 over ``(event_id, key, ts)``; output ``(event_id, key, ts, accepted)``, one row
    per request however late it is. Ids and keys keep their types.

    A request is accepted iff afterwards no window, before or after it, holds more than
    ``max_requests`` accepted ones; for requests in time order that is the batch rule. One that is more
    than ``lateness_us`` (a window unless given) older than its key's newest is rejected, since stamps that
    old are forgotten: a key's state is the accepted stamps of a window and that time, at most
    ``max_requests`` for every window begun in them. With ``idle_ms``, a key that was silent for so much
    processing time is forgotten (for streams that go on: with it, a run over what is available does
    not end by itself)."""
    df = (requests.select("event_id", "key", F.col("ts").cast("timestamp_ntz").alias("ts"))
          .withColumn("_us", epoch_micros("ts")))
    out = T.StructType([df.schema["event_id"], df.schema["key"], T.StructField("ts", T.TimestampNTZType()),
                        T.StructField("accepted", T.BooleanType())])
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    late = window_us if lateness_us is None else lateness_us
    return (df.groupBy("key").applyInPandasWithState(_rl_state_fn(window_us, max_requests, late, idle_ms), out, RL_STATE, "append", timeout))


# ---------------------------------------------------------------------------------------------
# ST3
# ---------------------------------------------------------------------------------------------

HIST_OUT = T.StructType([T.StructField("session_id", T.StringType()),
                         T.StructField("history", T.StringType()),
                         T.StructField("n_messages", T.IntegerType())])
HIST_STATE = T.StructType([T.StructField("seq", T.ArrayType(T.LongType())),
                           T.StructField("line", T.ArrayType(T.StringType()))])


def _history_fn(n: int, idle_ms: int | None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        seqs, lines = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        for pdf in pdfs:
            label = pdf["role"].map(lambda r: USER_LABEL if r == "user" else OTHER_LABEL)
            new_lines = [None if c is None else f"{lab}: {c}" for lab, c in zip(label, pdf["content"])]
            seqs += [int(x) for x in pdf["seq"]]
            lines += new_lines
            # keep only the newest n while consuming, so state stays bounded by n
            order = sorted(range(len(seqs)), key=lambda i: seqs[i])[-n:]
            seqs, lines = [seqs[i] for i in order], [lines[i] for i in order]
        state.update((seqs, lines))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        hist = "\n".join(x for x in lines if x is not None)
        yield pd.DataFrame({"session_id": [key[0]], "history": [hist], "n_messages": [len(seqs)]})
    return fn


def session_history_stream(messages: DataFrame, n: int = 10, idle_ms: int | None = None) -> DataFrame:
    """Streaming H1 over ``(session_id, seq, role, content)``; emits updated histories. With
    ``idle_ms``, a session that was silent for so much processing time is forgotten."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return (messages.groupBy("session_id")
            .applyInPandasWithState(_history_fn(n, idle_ms), HIST_OUT, HIST_STATE, "update", timeout))


def drain(query, timeout_s: float | None = None) -> None:
    """Wait until a stream ends. With ``timeout_s``, one that hasn't ended then is stopped and an
    error raised: a half-written sink is never taken for the whole."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout_s} s")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append",
                 timeout_s: float | None = None) -> None:
    """Drain a stream with ``availableNow`` into parquet (append) or per-epoch folders (update)."""
    if output_mode == "append":
        q = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(path))
    else:
        def sink(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        q = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    drain(q, timeout_s)
