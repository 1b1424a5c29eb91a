"""The registered queries."""

from . import order_queries, queries, road_queries, scene_queries, segment_queries

__all__ = ["order_queries", "queries", "road_queries", "scene_queries", "segment_queries"]
