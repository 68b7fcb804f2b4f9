"""Imports every module that registers named queries."""

from wardlight.plans import registry  # noqa: F401
from wardlight.plans import queries_shapes  # noqa: F401
from wardlight.plans import queries_ingest  # noqa: F401
from wardlight.plans import queries_vectors  # noqa: F401
from wardlight.plans import queries_documents  # noqa: F401
from wardlight.plans import queries_log  # noqa: F401
from wardlight.plans import queries_streaming  # noqa: F401
from wardlight.plans import queries_answers  # noqa: F401
