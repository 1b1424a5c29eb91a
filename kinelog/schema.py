"""Canonical tables and code lists."""

from __future__ import annotations

from pyspark.sql import types as T

AGENT_TYPES = {"unknown": 0, "vehicle": 1, "pedestrian": 2, "bicycle": 3, "motorcycle": 4}
LIGHTS = {"no_data": -1, "unknown": 0, "green": 1, "red": 2}
MAP_ELEMENTS = {"road_lane": 1, "road_area": 2, "ped_crosswalk": 3, "ped_walkway": 4}
#: Length and width in metres that stand in for a missing extent when drawing.
DRAWN = {1: (4.3, 1.8), 2: (0.5, 0.5), 3: (1.9, 0.5)}
DRAWN_ELSE = (1.0, 1.0)

AGENT = ("scene", "agent_id")
KINEMATICS = ("x", "y", "z", "vx", "vy", "ax", "ay")
EXTENTS = ("length", "width", "height")

POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "h")])
AGENT_STATES = T.StructType(
    [T.StructField("env", T.StringType()), T.StructField("scene", T.StringType()), T.StructField("agent_id", T.StringType()), T.StructField("scene_ts", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in (*KINEMATICS, "heading", *EXTENTS)]
)
MAP_ELEMENT = T.StructType(
    [T.StructField("map_id", T.StringType()), T.StructField("elem_id", T.StringType()), T.StructField("elem_type", T.IntegerType())]
    + [T.StructField(c, T.ArrayType(POINT)) for c in ("center", "left_edge", "right_edge", "polygon")]
    + [T.StructField("holes", T.ArrayType(T.ArrayType(POINT)))]
)
