"""All registered queries (importing a module registers its queries)."""

from . import board_queries, career_queries, feature_queries, ops_queries, payload_queries, schedule_queries, stream_queries, view_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
