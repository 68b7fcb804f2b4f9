"""Registered vector queries: T3/F12/F14 (vector_topk), V1 (vector_topk_batch), S12, S11, Q2, Q3."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from wardlight.functions.text import full_name
from wardlight.operators.entity_query import entity_query
from wardlight.operators.ingest import hashing_embedder, point_store
from wardlight.operators.passages import build_passages
from wardlight.operators.vectors import collection_stats, hybrid_envelope, sample_points, \
    vector_search, vector_topk_batch, vector_topk_queries, write_collection_info
from wardlight.plans.intent import Intent
from wardlight.plans.oracle_views import with_views
from wardlight.plans.queries_ingest import passages_sql
from wardlight.plans.registry import AS_OF, register
from wardlight.session import scratch_path
from wardlight.sources.tables import DRIVER_MAPPINGS, Catalog

_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _lookup_vector(spark, sf_dir, point_id: int):
    """The query vector of a search: one point lookup (a single row reaches the driver)."""
    row = Catalog(spark, sf_dir).vectors().where(F.col("id") == point_id).select("tenant_id", "embedding").first()
    return row["tenant_id"], [float(x) for x in row["embedding"]]


@register("vector_topk", with_views("vectors") +
          f""", q AS (SELECT tenant_id, embedding FROM vectors WHERE id = 0)
          SELECT v.id, v.tenant_id, round({_COS.format(a='v.embedding', b='q.embedding')}, 6) AS score
          FROM vectors v JOIN q ON v.tenant_id = q.tenant_id
          ORDER BY {_COS.format(a='v.embedding', b='q.embedding')} DESC, v.id LIMIT 5""")
def q_vector_topk(spark, sf_dir):
    tenant, qv = _lookup_vector(spark, sf_dir, 0)
    return vector_search(Catalog(spark, sf_dir).vectors(), qv, tenant, k=5)


@register("vector_topk_batch", with_views("vectors") +
          f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (
                SELECT q.id AS query_id, c.id, {_COS.format(a='q.embedding', b='c.embedding')} AS score,
                       row_number() OVER (PARTITION BY q.id ORDER BY
                           {_COS.format(a='q.embedding', b='c.embedding')} DESC, c.id) AS rank
                FROM vectors q JOIN vectors c ON q.tenant_id = c.tenant_id AND q.id <> c.id)
              WHERE rank <= 5""")
def q_vector_topk_batch(spark, sf_dir):
    v = Catalog(spark, sf_dir).vectors()
    queries = v.select(F.col("id").alias("query_id"), "tenant_id", F.col("embedding").alias("q_embedding"))
    return vector_topk_batch(queries, v, k=5, exclude_self=True, block_rows=128)


@register("vector_topk_hundredth", with_views("vectors") +
          f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (
                SELECT q.id AS query_id, c.id, {_COS.format(a='q.embedding', b='c.embedding')} AS score,
                       row_number() OVER (PARTITION BY q.id ORDER BY
                           {_COS.format(a='q.embedding', b='c.embedding')} DESC, c.id) AS rank
                FROM vectors q JOIN vectors c ON q.tenant_id = c.tenant_id AND q.id <> c.id WHERE q.id % 100 = 0)
              WHERE rank <= 10""")
def q_vector_topk_hundredth(spark, sf_dir):
    """The points whose id is divisible by 100 against all points of their tenant."""
    v = Catalog(spark, sf_dir).vectors()
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "tenant_id", F.col("embedding").alias("q_embedding"))
    return vector_topk_queries(queries, v, k=10, exclude_self=True)


@register("hits_with_payload", with_views("appointments") + ", points AS (" +
          passages_sql("appointments", "appointments", DRIVER_MAPPINGS["appointments"]) +
          f"""), q AS (SELECT embedding AS wanted FROM embeddings WHERE vec_id = 0)
          SELECT p.*, round({_COS.format(a='e.embedding', b='wanted')}, 6) AS score
          FROM points p JOIN embeddings e ON p.record_id = CAST(e.vec_id AS VARCHAR), q WHERE tenant_id = '1'
          ORDER BY {_COS.format(a='e.embedding', b='wanted')} DESC, p.id LIMIT 5""")
def q_hits_with_payload(spark, sf_dir):
    """Passages stored with the vector of the same number; the hits carry the whole payload."""
    cat = Catalog(spark, sf_dir)
    vectors = cat.vectors().select(F.col("id").cast("string").alias("record"), "embedding")
    points = build_passages(cat.appointments(), DRIVER_MAPPINGS["appointments"]).join(vectors, F.col("record_id") == F.col("record")).drop("record")
    store = point_store(spark, scratch_path(spark, "payload"))
    store.merge(points)
    return vector_search(store.read(), _lookup_vector(spark, sf_dir, 0)[1], "1", k=5)


@register("collection_info", with_views("vectors") +
          """SELECT tenant_id, count(*) AS points, min(len(embedding)) AS dim_min,
                    max(len(embedding)) AS dim_max, 'Cosine' AS distance FROM vectors GROUP BY tenant_id""")
def q_collection_info(spark, sf_dir):
    """The collection's statistics written as JSON lines and read back."""
    path = scratch_path(spark, "info")
    write_collection_info(collection_stats(Catalog(spark, sf_dir).vectors()), path)
    return spark.read.schema("tenant_id string, points long, dim_min long, dim_max long, distance string").json(path)


@register("vector_stats", with_views("vectors") +
          """SELECT tenant_id, count(*) AS points, min(len(embedding)) AS dim_min,
                    max(len(embedding)) AS dim_max, 'Cosine' AS distance FROM vectors GROUP BY tenant_id""")
def q_vector_stats(spark, sf_dir):
    return collection_stats(Catalog(spark, sf_dir).vectors())


@register("vector_sample", with_views("vectors") +
          "SELECT id, tenant_id FROM vectors ORDER BY id LIMIT 5")
def q_vector_sample(spark, sf_dir):
    return sample_points(Catalog(spark, sf_dir).vectors())


# Query text → vector with the deterministic hashing embedder (stands in for the endpoint).
_EMBED = hashing_embedder(64)
KNOWLEDGE_QUESTION = "Which notes mention a patient with a weak heart?"
HYBRID_QUESTION = "Who is doctor Supplier 000000002?"


def _qvec(text: str) -> list[float]:
    return [float(x) for x in _EMBED(pd.Series([text]))[0]]


def _lit_vec(v: list[float]) -> str:
    return "[" + ", ".join(repr(x) for x in v) + "]"


@register("knowledge_lookup", with_views("vectors") +
          f"""SELECT id, tenant_id, round({_COS.format(a='embedding', b=_lit_vec(_qvec(KNOWLEDGE_QUESTION)))}, 6) AS score
              FROM vectors WHERE tenant_id = '0'
              ORDER BY {_COS.format(a='embedding', b=_lit_vec(_qvec(KNOWLEDGE_QUESTION)))} DESC, id LIMIT 5""")
def q_knowledge_lookup(spark, sf_dir):
    return vector_search(Catalog(spark, sf_dir).vectors(), _qvec(KNOWLEDGE_QUESTION), "0", k=5)


@register("hybrid_lookup", with_views("doctors", "vectors") +
          f"""SELECT * FROM (SELECT 'sql' AS source, tenant_id, CAST(id AS VARCHAR) AS record_id,
                     first_name || ' ' || last_name AS title, CAST(NULL AS DOUBLE) AS score
              FROM doctors WHERE tenant_id = '2'
                AND contains(lower(first_name || ' ' || last_name), 'supplier 000000002')
              ORDER BY id LIMIT 5)
          UNION ALL
          SELECT * FROM (SELECT 'vector' AS source, tenant_id, CAST(id AS VARCHAR) AS record_id,
                     CAST(NULL AS VARCHAR) AS title,
                     round({_COS.format(a='embedding', b=_lit_vec(_qvec(HYBRID_QUESTION)))}, 6) AS score
              FROM vectors WHERE tenant_id = '2'
              ORDER BY {_COS.format(a='embedding', b=_lit_vec(_qvec(HYBRID_QUESTION)))} DESC, id LIMIT 5)""")
def q_hybrid_lookup(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    intent = Intent.of("semantic_lookup", ["doctors"], doctorName="Supplier 000000002")
    rows = entity_query(cat.tables(), DRIVER_MAPPINGS, intent, "2", AS_OF)
    hits = vector_search(cat.vectors(), _qvec(HYBRID_QUESTION), "2", k=5)
    return hybrid_envelope(rows, hits, sql_title=full_name(F.col("first_name"), F.col("last_name")))
