"""Map points on disk in the order of a space-filling curve, with the bounds of each file, and searches that read only files they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maps import found_place, near_points
from ..operators.nearest import BITS, cell_size, curve_key

#: Points of a file, about; cells along the longest side of a file's bounds in a search.
FILE_POINTS, ACROSS = 1_000_000, 16
_AXES = ("x", "y")


def save_points(points: DataFrame, path: str, file_points: int = FILE_POINTS) -> None:
    """``points`` (map_id, elem_id, seq, x, y, z, h) under ``path``/points, cut by map and curve into files of about ``file_points``, and ``path``/bounds with a row a file and map.

    Points without a map or a place are left out, as no search finds them. Cells come from the points' density, and grow where a map has more than 2 ** BITS of them along a side.
    """
    points = points.filter(found_place("x", "y") & F.col("map_id").isNotNull())
    low = points.groupBy("map_id").agg(*(F.min(c).alias(f"_{c}") for c in _AXES), F.greatest(*(F.max(c) - F.min(c) for c in _AXES)).alias("_side"), F.count("*").alias("_n"))
    total, side = low.agg(F.sum("_n"), F.max("_side")).first()
    cell = max(cell_size(points), (side or 0.0) / (2**BITS - 1))
    place = lambda c: F.least(F.floor((F.col(c) - F.col(f"_{c}")) / cell), F.lit(2**BITS - 1)).cast("long")
    keyed = points.join(low, "map_id").withColumn("_key", curve_key(place("x"), place("y")))
    keyed.repartitionByRange(max(1, -(-(total or 0) // file_points)), "map_id", "_key", "elem_id", "seq").sortWithinPartitions("map_id", "_key").select(*points.columns).write.mode("overwrite").parquet(f"{path}/points")
    stored = points.sparkSession.read.schema(points.schema).parquet(f"{path}/points").withColumn("file", F.col("_metadata.file_name"))
    bounds = stored.groupBy("file", "map_id").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{k}") for c in _AXES for f, k in ((F.min, 0), (F.max, 1))))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def files_near(places: DataFrame, bounds: DataFrame, radius: float) -> DataFrame:
    """(file) of those with bounds at most ``radius`` from one of ``places`` (map_id, x, y): an equi-join of the cells around each place with those that bounds cover.

    A cell is as wide as the radius, or a sixteenth of the longest bounds if that is more, so bounds cover few cells however they lie.
    """
    longest = bounds.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0]
    cell = max(radius, (longest or 0.0) / ACROSS) or 1.0
    at = lambda c: F.floor(c / cell)
    # Cells of places, and the box that a cell's places lie in: many places in one cell ask once.
    asked = places.filter(found_place("x", "y")).groupBy("map_id", at(F.col("x")).alias("cx"), at(F.col("y")).alias("cy")).agg(*(f(c).alias(f"{c}{k}") for c in _AXES for f, k in ((F.min, 2), (F.max, 3))))
    span = lambda c: F.explode(F.sequence(at(F.col(f"{c}0") - radius), at(F.col(f"{c}1") + radius)))
    held = bounds.withColumn("cx", span("x")).withColumn("cy", span("y"))
    gap = lambda c: F.greatest(F.col(f"{c}0") - F.col(f"{c}3"), F.col(f"{c}2") - F.col(f"{c}1"), F.lit(0.0))
    return held.join(asked, ["map_id", "cx", "cy"]).filter(F.hypot(gap("x"), gap("y")) <= radius * (1 + 1e-9)).select("file").distinct()


def points_near(spark: SparkSession, path: str, places: DataFrame, radius: float) -> DataFrame:
    """The stored points of all files that hold any at most ``radius`` from one of ``places``, and maybe others of these files.

    The names of these files go through the driver, as those of any table that is read do.
    """
    files = [f"{path}/points/{row.file}" for row in files_near(places, spark.read.parquet(f"{path}/bounds"), radius).collect()]
    schema = spark.read.parquet(f"{path}/points").schema
    return spark.read.schema(schema).parquet(*sorted(files)) if files else spark.createDataFrame([], schema)


def stored_within(spark: SparkSession, path: str, places: DataFrame, radius: float, flat: bool = False) -> DataFrame:
    """``maps.near_points`` over stored points: pairs of a place and a point at most ``radius`` away. Files too far from all places aren't opened."""
    return near_points(places, points_near(spark, path, places, radius), radius, flat)
