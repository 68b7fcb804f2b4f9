"""Incremental ingestion: checkpoint → changed rows → passages → embed → upsert → new checkpoint.

Shapes at scale:

* S6/F11 changed rows: ``updated_at > high_water`` where the high-water comes from a state table
  keyed by ``(tenant_id, table_name)``; the state is joined on ``tenant_id`` (one row per tenant,
  AQE broadcasts it when small), so every tenant has its own mark and ``--tenant`` never advances
  another tenant's.
* I2 embedding: distinct texts only (keyed by md5 of the text), batched through ``mapInPandas``
  with a user-supplied callable; failures go to a quarantine frame instead of failing the job. With a
  vector cache (a store keyed by the same md5), only texts that no run has embedded yet are sent.
* S9 upsert: newest wins by ``updated_at``, in whatever order versions arrive. The point store
  (``point_store``) keeps hash-bucketed deltas, so a batch writes its own rows only, and publishes
  rows, quarantine and stream epoch in one step.
* A3/S8 high-water: ``max(updated_at)`` of successfully embedded rows, merged with the old mark by
  ``greatest``; written only after the data version is committed.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.dates import ts_literal
from wardlight.operators.passages import PASSAGE_SCHEMA, build_passages
from wardlight.operators.point_store import BUCKETS, MAX_DELTAS, PointStore, SmallTable
from wardlight.session import checkpoint_root, drop_scratch, scratch_path
from wardlight.sources.mapping import EntityMapping

EPOCH = dt.datetime(1970, 1, 1)

STATE_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("high_water", T.TimestampNTZType()),
])

Embedder = Callable[[pd.Series], pd.Series]


# ---------------------------------------------------------------------------------------------
# Changed rows after a per-tenant checkpoint
# ---------------------------------------------------------------------------------------------

def changed_rows(df: DataFrame, table_name: str, state: DataFrame | None, *,
                 tenant: str | None = None, resync: bool = False,
                 overlap: dt.timedelta | None = None, tenant_col: str = "tenant_id",
                 ts_col: str = "updated_at") -> DataFrame:
    """Rows with ``ts_col`` strictly after their tenant's high-water mark.

    ``overlap`` re-reads ``(hw - overlap, hw]`` as well, to catch rows committed late; the stable
    point id makes the replay idempotent.
    """
    out = df
    if tenant is not None:
        out = out.where(F.col(tenant_col) == F.lit(str(tenant)))
    if resync or state is None:
        return out.where(F.col(ts_col) > ts_literal(EPOCH))
    st = (state.where(F.col("table_name") == table_name)
          .select(F.col("tenant_id").alias("_st_tenant"), F.col("high_water").alias("_hw")))
    if tenant is not None:
        st = st.where(F.col("_st_tenant") == F.lit(str(tenant)))
    hw = F.coalesce(F.col("_hw"), ts_literal(EPOCH))
    if overlap is not None:
        hw = hw - F.expr(f"INTERVAL {int(overlap.total_seconds() * 1_000_000)} MICROSECONDS")
    return (out.join(st, F.col(tenant_col).cast("string") == F.col("_st_tenant"), "left")
            .where(F.col(ts_col) > hw).drop("_st_tenant", "_hw"))


# ---------------------------------------------------------------------------------------------
# Keyed upsert, newest wins
# ---------------------------------------------------------------------------------------------

def newest_per_id(df: DataFrame, id_col: str = "id", ts_col: str = "updated_at") -> DataFrame:
    """One row per id: greatest ``ts_col`` (ties → greatest text). A partial aggregate, so a hot
    id is combined map-side instead of being funnelled into one task."""
    cols = [c for c in df.columns]
    rank = F.struct(F.col(ts_col), F.col("text")) if "text" in cols else F.struct(F.col(ts_col))
    agg = df.groupBy(id_col).agg(F.max_by(F.struct(*[F.col(c) for c in cols if c != id_col]), rank).alias("_r"))
    return agg.select(id_col, *[F.col("_r." + c).alias(c) for c in cols if c != id_col]).select(cols)


def upsert(store: DataFrame, incoming: DataFrame, id_col: str = "id") -> DataFrame:
    """The newest version of every point, stored or incoming: an older one never replaces a newer one."""
    return newest_per_id(store.unionByName(incoming), id_col)


def point_store(spark: SparkSession, root: str, buckets: int = BUCKETS, max_deltas: int = MAX_DELTAS) -> PointStore:
    """The store of ingested points under ``root``."""
    return PointStore(spark, root, newest_per_id, buckets=buckets, max_deltas=max_deltas)


# ---------------------------------------------------------------------------------------------
# High-water marks
# ---------------------------------------------------------------------------------------------

def high_water(processed: DataFrame, old_state: DataFrame | None = None) -> DataFrame:
    new = (processed.where(F.col("updated_at").isNotNull())
           .groupBy("tenant_id", "table_name").agg(F.max("updated_at").alias("_new")))
    if old_state is None:
        return new.select("tenant_id", "table_name", F.col("_new").alias("high_water"))
    j = old_state.join(new, ["tenant_id", "table_name"], "full_outer")
    return j.select("tenant_id", "table_name",
                    F.greatest(F.col("high_water"), F.col("_new")).alias("high_water"))


# ---------------------------------------------------------------------------------------------
# Embedding with a user callable, failures quarantined
# ---------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\w+", re.UNICODE)


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic feature-hashing embedder (tests, benches, offline runs)."""
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        places: dict[str, tuple[int, float]] = {}        # a token is hashed once a batch
        for t in texts:
            v = [0.0] * dim
            for tok in _TOKEN.findall((t or "").lower()):
                place = places.get(tok)
                if place is None:
                    h = int.from_bytes(hashlib.blake2b(tok.encode("utf-8"), digest_size=8).digest(), "little")
                    place = places[tok] = (h % dim, 1.0 if (h >> 63) & 1 else -1.0)
                v[place[0]] += place[1]
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n > 0 else v)
        return pd.Series(out)
    return embed


EMBED_SCHEMA = T.StructType([
    T.StructField("text_key", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("error", T.StringType()),
])


def _embed_batches(embedders: list[Embedder]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vecs, errs = None, None
            last = ""
            for emb in embedders:  # ordered model fallback for the whole batch
                try:
                    vecs = list(emb(b["text"].reset_index(drop=True)))
                    break
                except Exception as e:  # noqa: BLE001
                    last = f"{type(e).__name__}: {e}"
            if vecs is None:  # batch failed everywhere: retry row by row to isolate bad rows
                vecs, errs = [], []
                for t in b["text"]:
                    v, err = None, last
                    for emb in embedders:
                        try:
                            v = list(emb(pd.Series([t])))[0]
                            err = None
                            break
                        except Exception as e:  # noqa: BLE001
                            err = f"{type(e).__name__}: {e}"
                    vecs.append(v)
                    errs.append(err)
            yield pd.DataFrame({"text_key": b["text_key"].values,
                                "embedding": vecs,
                                "error": errs if errs is not None else [None] * len(b)})
    return run


def vector_cache(spark: SparkSession, root: str) -> PointStore:
    """Vectors by md5 of their text. One root per embedding model: a key says nothing of the model."""
    return PointStore(spark, root, id_col="text_key", newest=lambda rows: rows.groupBy("text_key").agg(
        F.min_by("embedding", F.xxhash64("embedding")).alias("embedding")))


def embed_all(passages: DataFrame, embedders: Embedder | list[Embedder], *, cache: PointStore | None = None,
              parallelism: int | None = None) -> DataFrame:
    """Passages + ``embedding`` + ``error`` (null when embedded). Each distinct text is sent to
    the embedder once; repeated texts share the vector through a join on md5(text).

    With a ``cache`` only texts that it lacks are sent, and their vectors are added to it before this
    returns. ``parallelism`` is the number of tasks, so of callers of the embedding service at once."""
    embs = embedders if isinstance(embedders, list) else [embedders]
    keyed = passages.withColumn("text_key", F.md5(F.col("text")))
    distinct = keyed.select("text_key", "text").dropDuplicates(["text_key"])

    def embedded(texts: DataFrame) -> DataFrame:
        return (texts.repartition(parallelism, "text_key") if parallelism else texts).mapInPandas(_embed_batches(embs), EMBED_SCHEMA)

    if cache is None:
        vectors = embedded(distinct)
    else:
        checkpoint_root(passages.sparkSession)
        known = cache.read() if cache.exists() else None
        fresh = embedded(distinct if known is None else distinct.join(known.select("text_key"), "text_key", "left_anti")).checkpoint()
        cache.merge(fresh.where("embedding is not null").select("text_key", "embedding"))
        vectors = fresh if known is None else fresh.unionByName(
            known.join(distinct.select("text_key"), "text_key", "left_semi").withColumn("error", F.lit(None).cast("string")))
    return keyed.join(vectors, "text_key", "inner").drop("text_key") \
        .withColumn("error", F.when(F.col("embedding").isNull(), F.coalesce(F.col("error"), F.lit("no vector")))
                    .otherwise(F.col("error")))


def split_embedded(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(points, quarantine)`` of an ``embed_all`` frame."""
    points = embedded.where(F.col("error").isNull()).drop("error")
    quarantine = embedded.where(F.col("error").isNotNull()) \
        .select(*[c for c in PASSAGE_SCHEMA.fieldNames()], "error")
    return points, quarantine


def embed_passages(passages: DataFrame, embedders: Embedder | list[Embedder]
                   ) -> tuple[DataFrame, DataFrame]:
    """Returns ``(points, quarantine)``: points = passages + embedding; quarantine = failed rows.

    Both derive from one embedding plan: cut it (``checkpoint``) before using both, or the
    embedder runs twice."""
    return split_embedded(embed_all(passages, embedders))


# ---------------------------------------------------------------------------------------------
# The batch job
# ---------------------------------------------------------------------------------------------

def _written(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, str]:
    """Rows as a compressed table of their own, and its folder (a checkpoint's rows are not compressed)."""
    path = scratch_path(spark, "ingest-rows")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def run_incremental_ingest(spark: SparkSession, sources: dict[str, tuple[DataFrame, EntityMapping]],
                           store_root: str, state_root: str, embedders: Embedder | list[Embedder],
                           *, tenant: str | None = None, tables: list[str] | None = None,
                           resync: bool = False, overlap: dt.timedelta | None = None, buckets: int = BUCKETS,
                           max_deltas: int = MAX_DELTAS, cache_root: str | None = None,
                           embed_parallelism: int | None = None) -> dict:
    """Batch ingest over all (or the chosen) mapped tables into the point store under ``store_root``;
    returns counters and the store's version.

    Data version is written first, state second: a crash between them replays the batch next run,
    which changes nothing, as the newest version of a point wins whenever it arrives. Rows quarantined
    by earlier runs, of batches or streams, are tried again in this run's scope, so a failure is never
    skipped by a later high-water mark; a replayed version that is older than the stored one loses.
    """
    checkpoint_root(spark)
    marks = SmallTable(spark, state_root)
    state = marks.read()
    store = point_store(spark, store_root, buckets, max_deltas)
    batches = []
    for entity, (df, mapping) in sources.items():
        if tables and entity not in tables and mapping.table not in tables:
            continue
        ch = changed_rows(df, mapping.table, state, tenant=tenant, resync=resync, overlap=overlap)
        batches.append(build_passages(ch, mapping, tenant))
    retried, failed = store.quarantine()
    held = None
    if failed is not None:
        # retried within this run's scope; the rest is carried forward as it is
        mine = F.lit(True) if tenant is None else F.col("tenant_id").eqNullSafe(F.lit(str(tenant)))
        if tables:
            names = [m.table for e, (_, m) in sources.items() if e in tables or m.table in tables]
            mine = mine & F.coalesce(F.col("table_name").isin(names), F.lit(False))
        batches.append(failed.where(mine).drop("error"))
        held = failed.where(~mine)
    if not batches:
        return {"processed": 0, "failed": 0}
    incoming = batches[0]
    for b in batches[1:]:
        incoming = incoming.unionByName(b)
    # read twice below, by the embedder and by the join with its vectors: passages are built once
    incoming, built = _written(spark, newest_per_id(incoming))
    # A4: counters observed on the one pass that embeds (no second pass to count)
    obs = Observation("ingest")
    embedded = embed_all(incoming, embedders, cache=vector_cache(spark, cache_root) if cache_root else None,
                         parallelism=embed_parallelism).observe(
        obs, F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col("error").isNull(), 1).otherwise(0)).alias("processed"))
    # written once: the embedded batch feeds the store, the quarantine and the state, and
    # the (expensive, external) embedder must run exactly once
    embedded, vectors = _written(spark, embedded)
    counters = obs.get
    points, quarantine = split_embedded(embedded)
    if held is not None:
        quarantine = quarantine.unionByName(held)
    version = store.merge(points, failed=quarantine, retried=retried, unique=True)      # incoming holds an id once
    marks.update(lambda old: high_water(points, old))
    for path in (built, vectors):
        drop_scratch(spark, path)
    rows, processed = int(counters.get("rows") or 0), int(counters.get("processed") or 0)
    return {"processed": processed, "failed": rows - processed, "store": store_root, "version": version}
