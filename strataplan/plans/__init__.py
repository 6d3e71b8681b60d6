"""Named queries of the engine; importing a module registers its queries."""

from . import aggregate_queries, drawing_queries, filter_queries, join_queries, kernel_queries, outline_queries, raster_queries, scalar_queries, sink_queries, stream_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
