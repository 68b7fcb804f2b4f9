"""wardlight: multi-tenant clinical-records analytics expressed as Spark DataFrame jobs.

Sub-packages
------------
sources    -- table loading, entity mappings, catalog listing, checkpoint state, candidate tables
functions  -- column-expression helpers (truthy coalesce, JS-style trim, dates, names, JSON repair)
operators  -- the user-level jobs (entity queries, passages/ingest, vectors, documents, bookings, ...)
plans      -- intent model and the registry of named queries used by the driver entry point
streaming  -- Structured Streaming forms of ingest, rate limiting and session history
"""

from wardlight.session import get_session, checkpoint_root  # noqa: F401

__all__ = ["get_session", "checkpoint_root"]
