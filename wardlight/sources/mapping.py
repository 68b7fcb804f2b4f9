"""Entity mappings: logical alias → physical column, per entity (S3).

A mapping is plain configuration. ``apply_mapping`` turns it into one ``select`` with aliases, so
Catalyst prunes every unmapped column at the scan. Beside its columns an entity may name the parent
that its tenant comes from (``tenantVia``: the alias of its key and the parent entity) and the
dimension tables that give words for ids (``lookups``: per alias the entity and its id and name columns).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.text import PASSWORD_KEY_PART


@dataclass(frozen=True)
class EntityMapping:
    entity: str
    table: str
    columns: dict[str, str] = field(default_factory=dict)  # alias -> physical, insertion-ordered
    tenant_via: tuple[str, str] | None = None              # alias of the key, parent entity
    lookups: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # alias -> entity, id and name column

    def physical(self, alias: str) -> str | None:
        return self.columns.get(alias)

    @property
    def tenant_column(self) -> str | None:
        return self.columns.get("tenant")

    def has_physical(self, col: str) -> bool:
        return col in self.columns.values()


def parse_mapping(text: str | bytes, defaults: dict[str, EntityMapping] | None = None
                  ) -> dict[str, EntityMapping]:
    """Parse the JSON mapping file: BOM stripped, keys containing ``password`` dropped.

    A file that does not parse falls back to ``defaults`` (like the reference's loader).
    """
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    try:
        data = json.loads(text.strip().lstrip("﻿"))
        out: dict[str, EntityMapping] = {}
        for entity, cfg in data.items():
            if not isinstance(cfg, dict) or "table" not in cfg:
                raise ValueError(f"entity {entity!r} has no table")
            cols = {k: v for k, v in cfg.items()
                    if k != "table" and PASSWORD_KEY_PART not in k.lower() and isinstance(v, str)}
            via = cfg.get("tenantVia")
            words = {alias: (w["entity"], w["id"], w["name"]) for alias, w in (cfg.get("lookups") or {}).items()}
            out[entity] = EntityMapping(entity, cfg["table"], cols, (via["key"], via["entity"]) if via else None, words)
        return out
    except (ValueError, AttributeError, KeyError, TypeError):
        if defaults is None:
            raise
        return dict(defaults)


def apply_mapping(df: DataFrame, mapping: EntityMapping, strict: bool = True) -> DataFrame:
    """``SELECT phys AS alias, …`` for every mapped column present in ``df``.

    ``strict`` raises on a mapped column missing from the table; otherwise it is skipped.
    """
    present = set(df.columns)
    missing = [p for p in mapping.columns.values() if p not in present]
    if missing and strict:
        raise ValueError(f"{mapping.entity}: mapped columns not in table {mapping.table}: {missing}")
    return df.select([F.col(p).alias(a) for a, p in mapping.columns.items() if p in present])
