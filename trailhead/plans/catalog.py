"""All registered queries; importing the modules fills the registry."""

from . import (  # noqa: F401
    queries_authority,
    queries_feedback,
    queries_rank,
    queries_stream,
    queries_telemetry,
    queries_text,
    queries_vectors,
)
from .registry import ORACLES, QUERIES  # noqa: F401
