"""Mapped entity rows → cleaned, stably keyed text passages (one narrow stage, no shuffle).

For every mapped alias, in mapping order: value → ``String(value)`` → JS trim → dropped when
null / empty / longer than 500 / a 32+ hex-digit hash / an inline image, or when the key names a
token, path or url; kept parts become ``"alias: value"``, joined by ``", "`` and cut to 2000
characters. Title = the last kept value whose alias contains "title" or "name", else the first 100
characters of the text. Point id = md5(``table:tenant:record``) in 8-4-4-4-12 form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.text import clean_value, falsy_to_null, js_string, stable_id
from wardlight.sources.mapping import EntityMapping

# Passage length cap, title fallback length, tenant of rows without one.
MAX_TEXT_CHARS = 2000
TITLE_FALLBACK_CHARS = 100
DEFAULT_TENANT = "default"

PASSAGE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("patient_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])


def _is_title_alias(alias: str) -> bool:
    a = alias.lower()
    return "title" in a or "name" in a


def passage_columns(df: DataFrame, mapping: EntityMapping, tenant_arg: str | None = None
                    ) -> dict[str, Column]:
    schema = {f.name: f.dataType for f in df.schema.fields}
    parts: list[Column] = []
    titles: list[Column] = []
    for alias, phys in mapping.columns.items():
        if phys not in schema:
            continue
        cleaned = clean_value(alias, F.col(phys), schema[phys])
        if cleaned is None:
            continue
        parts.append(F.concat(F.lit(f"{alias}: "), cleaned))
        if _is_title_alias(alias):
            titles.append(cleaned)
    text = F.substring(F.concat_ws(", ", *parts), 1, MAX_TEXT_CHARS) if parts else F.lit("")
    title = F.coalesce(*reversed(titles), F.substring(text, 1, TITLE_FALLBACK_CHARS)) if titles \
        else F.substring(text, 1, TITLE_FALLBACK_CHARS)
    if "tenant_id" in schema:
        tdt = schema["tenant_id"]
        tenant_parts = [js_string(falsy_to_null(F.col("tenant_id"), tdt), tdt)]
    else:
        tenant_parts = []
    if tenant_arg:
        tenant_parts.append(F.lit(str(tenant_arg)))
    tenant_parts.append(F.lit(DEFAULT_TENANT))
    tenant = F.coalesce(*tenant_parts)
    record = js_string(F.col("id"), schema["id"])
    if "patient_id" in schema:
        patient = falsy_to_null(F.col("patient_id"), schema["patient_id"]).cast("bigint")
    else:
        patient = F.lit(None).cast("bigint")
    updated = F.col("updated_at").cast("timestamp_ntz") if "updated_at" in schema \
        else F.lit(None).cast("timestamp_ntz")
    return {"tenant_id": tenant, "record_id": record, "patient_id": patient, "title": title,
            "text": text, "updated_at": updated}


def build_passages(df: DataFrame, mapping: EntityMapping, tenant_arg: str | None = None) -> DataFrame:
    """One passage row per entity row (schema ``PASSAGE_SCHEMA``)."""
    c = passage_columns(df, mapping, tenant_arg)
    out = df.select(
        F.lit(mapping.table).alias("table_name"),
        c["tenant_id"].alias("tenant_id"), c["record_id"].alias("record_id"),
        c["patient_id"].alias("patient_id"), c["title"].alias("title"), c["text"].alias("text"),
        c["updated_at"].alias("updated_at"))
    # a row without an id is known by its text, so such rows don't replace each other
    key = F.coalesce("record_id", F.concat(F.lit("null:"), F.md5("text")))
    out = out.withColumn("id", stable_id(mapping.table, F.col("tenant_id"), key))
    return out.select([f.name for f in PASSAGE_SCHEMA.fields])
