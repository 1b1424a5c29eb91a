"""Tables of scenes, lights, maps, indexes and elements on disk, partitioned by what they are looked up by.

Each write replaces the partitions that it brings and no others, so a rerun does no harm.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import of_source
from ..operators.maps import layers_of


def _save(rows: DataFrame, path: str, *by: str, order: tuple[str, ...] = ()) -> None:
    rows = rows.repartition(*by, *order[:1])
    (rows.sortWithinPartitions(*by, *order) if order else rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_lights(lights: DataFrame, path: str, env: str, dt: float) -> None:
    """scene, lane_id, scene_ts, status of one source and timestep."""
    _save(lights.withColumns({"env": F.lit(env), "dt": F.lit(f"{dt:.2f}")}), path, "env", "dt", order=("scene", "lane_id", "scene_ts"))


def read_lights(spark: SparkSession, path: str, env: str, dt: float) -> DataFrame:
    """Lights of one source and timestep; other partitions are pruned."""
    return spark.read.parquet(path).filter((F.col("env") == env) & (F.col("dt").cast("double") == round(dt, 2))).drop("env", "dt")


def save_scenes(scenes: DataFrame, path: str) -> None:
    """The scene list: env, name, location, data_split, length_timesteps, description, dt."""
    _save(scenes, path, "env", order=("name",))


def read_scenes(spark: SparkSession, path: str, env: str, wanted: list[str], descriptions: list[str] | None = None, by_prefix: bool = False) -> DataFrame:
    """The stored scenes of a source that fit tags and descriptions."""
    return of_source(spark.read.parquet(path), env, wanted, descriptions, by_prefix)


def save_maps(elements: DataFrame, path: str, locations: list[str] | None = None) -> None:
    """Map elements of any number of maps at once, each its own partition; of all maps, or those of some locations alone."""
    if locations is not None:
        elements = elements.filter(F.col("map_id").isin(*locations))
    _save(elements, path, "map_id", order=("elem_type", "elem_id"))


def read_map(spark: SparkSession, path: str, map_id: str, layers: tuple[str, ...] | None = None) -> DataFrame:
    """The elements of one map, of all layers or some; an unknown name is an error."""
    found = layers_of(spark.read.parquet(path).filter(F.col("map_id") == map_id))
    if found.isEmpty():
        raise ValueError(f"no map {map_id!r}")
    return layers_of(found, layers)


def key_of(arguments: dict) -> str:
    """What an index or a set of elements is stored under: a digest of the arguments it was made with."""
    return hashlib.sha1(json.dumps(arguments, sort_keys=True, default=str).encode()).hexdigest()


def stored(spark: SparkSession, path: str, arguments: dict, make) -> DataFrame:
    """The rows stored under the arguments, or those that ``make()`` returns, stored first. The marker of a finished write decides."""
    place = f"{path}/key={key_of(arguments)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def stored_elements(spark: SparkSession, path: str, arguments: dict, elements, index: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """As ``stored``, for elements of an index: stored rows of another index are an error."""
    found = stored(spark, path, arguments, elements)
    if not found.select(*keys).exceptAll(index.select(*keys)).isEmpty():
        raise ValueError("the stored elements belong to another index")
    return found
