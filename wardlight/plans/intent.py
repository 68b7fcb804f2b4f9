"""The structured intent a question is turned into (operation, targets, filters)."""

from __future__ import annotations

from dataclasses import dataclass, field

# The operation vocabulary and the queryable targets.
OPERATIONS = ("aggregate", "list", "lookup", "semantic_lookup", "general_knowledge", "book",
              "export_pdf")
TARGETS = ("patients", "doctors", "appointments", "prescriptions")
DEFAULT_LIMIT = 5
DEFAULT_TARGET = "appointments"


@dataclass
class Filters:
    doctorName: str | None = None
    patientName: str | None = None
    department: str | None = None
    status: str | None = None
    date: str | None = None
    minExperience: float | None = None
    limit: float | None = DEFAULT_LIMIT


@dataclass
class Intent:
    operation: str = "list"
    targets: list[str] = field(default_factory=list)
    filters: Filters = field(default_factory=Filters)
    justification: str = ""

    @staticmethod
    def of(operation: str, targets: list[str] | None = None, **filters) -> "Intent":
        return Intent(operation, list(targets or []), Filters(**filters))

    def target(self) -> str:
        """First target, default appointments; ``prescriptions`` forced for an export."""
        t = self.targets[0] if self.targets else DEFAULT_TARGET
        if self.operation == "export_pdf" and "prescriptions" in self.targets:
            t = "prescriptions"
        return t

    def row_limit(self) -> int:
        """``limit || 5``: missing, zero or NaN fall back to the default."""
        lim = self.filters.limit
        if not lim or lim != lim:
            return DEFAULT_LIMIT
        return max(int(lim), 0)
