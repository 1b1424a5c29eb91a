"""State formats: an ordered list of elements, derived from others where they are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .angles import lon_lat

#: Element -> column of the canonical table.
STORED = {"x": "x", "y": "y", "z": "z", "xd": "vx", "yd": "vy", "zd": "vz", "xdd": "ax", "ydd": "ay", "zdd": "az", "h": "heading", "dh": "dh", "s": "sin_heading", "c": "cos_heading", "v_lon": "v_lon", "v_lat": "v_lat"}


def resolve(element: str, columns: set[str], depth: int = 2) -> Column:
    """The column of an element, or an expression of others that gives it."""
    if element not in STORED:
        raise ValueError(f"no such element: {element}")
    if STORED[element] in columns:
        return F.col(STORED[element])
    if depth:
        get = lambda e: resolve(e, columns, depth - 1)
        if element in ("c", "s"):
            return (F.cos if element == "c" else F.sin)(get("h"))
        if element == "h":
            return F.atan2(get("s"), get("c"))
        if element in ("v_lon", "v_lat"):
            return lon_lat(get("xd"), get("yd"), get("h"))[element == "v_lat"]
        if element == "xd":
            return get("v_lon") * get("c") - get("v_lat") * get("s")
        if element == "yd":
            return get("v_lon") * get("s") + get("v_lat") * get("c")
    raise ValueError(f"{element} can't be had from {sorted(columns)}")


def as_format(states: DataFrame, fmt: str, keep: tuple[str, ...] = ("scene", "agent_id", "scene_ts")) -> DataFrame:
    """The keys and the elements of a format such as ``x,y,xd,yd,s,c``, in that order."""
    columns = set(states.columns)
    return states.select(*keep, *(resolve(e, columns).alias(e) for e in fmt.split(",")))


#: Named properties of a state and the elements that they are made of.
PROPERTIES = {"position": "x,y", "position3d": "x,y,z", "velocity": "xd,yd", "acceleration": "xdd,ydd", "heading": "h", "heading_vector": "c,s"}


def named(states: DataFrame, *names: str, keep: tuple[str, ...] = ("scene", "agent_id", "scene_ts")) -> DataFrame:
    """The keys and, for each named property, an array of its elements."""
    columns = set(states.columns)
    unknown = [n for n in names if n not in PROPERTIES]
    if unknown:
        raise ValueError(f"no such property: {unknown}")
    return states.select(*keep, *(F.array(*(resolve(e, columns) for e in PROPERTIES[n].split(","))).alias(n) for n in names))
