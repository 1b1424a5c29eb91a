"""Sources of tracks: text tables, scenario parquet, nested tracks, and the tables of a driving log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import yaw
from ..operators.chains import ranked
from .common import AGENT, Scenes, canonical, diff, drop_single_detections, interpolated, mapped_type, velocities

#: Types and extents (length, width, height in metres) by label.
WALKER = (0.75, 0.75, 1.5)
DRONE_TYPES = {"Pedestrian": 2, "Biker": 3, "Cart": 1, "Car": 1, "Bus": 1}
SCENARIO_OBJECTS = {"vehicle": (1, 4.0, 2.0, 2.0), "pedestrian": (2, 0.7, 0.7, 2.0), "motorcyclist": (4, 2.0, 0.7, 2.0), "cyclist": (3, 2.0, 0.7, 2.0), "bus": (1, 9.0, 3.0, 4.0)}
JUNCTION_OBJECTS = {
    "car": (1, 4.5, 2.0, 1.5), "truck": (1, 10.0, 2.5, 3.0), "bus": (1, 9.0, 3.0, 4.0), "motorcycle": (4, 2.0, 0.8, 1.5), "bicycle": (3, 1.8, 0.6, 1.5),
    "tricycle": (1, 3.5, 1.5, 1.5), "pedestrian": (2, 0.7, 0.7, 1.7), "mv": (1, 4.5, 2.0, 1.5), "nmv": (3, 1.8, 0.6, 1.5),
}
LIGHT_CODES = {"green": 1, "red": 2}
#: The extents (length, width, height) of each source's own car.
LOG_CAR = (5.176, 2.297, 1.777)
SAMPLE_CAR = (4.084, 1.730, 1.562)
INTERVAL_CAR = (4.869, 1.852, 1.476)


def _extent(label, table: dict[str, tuple]):
    """agent_type, length, width, height as columns looked up by a label."""
    out = [F.lit(None)] * 4
    for name, values in table.items():
        out = [F.when(label == name, F.lit(v)).otherwise(o) for o, v in zip(out, values)]
    return {"agent_type": out[0].cast("int"), **{c: o.cast("double") for c, o in zip(("length", "width", "height"), out[1:])}}


def walkers(spark: SparkSession, path: str, part: str | None = None, split_frame: dict[str, int] | None = None) -> Scenes:
    """Tab-separated frame, track, x, y at 0.4 s, every tenth frame; a scene is a file. ``part``: train or val, cut at a frame of each scene."""
    rows = spark.read.csv(path, sep="\t", schema="frame double, track double, x double, y double").withColumn("scene", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1))
    first = F.min("frame").over(Window.partitionBy("scene"))
    rows = rows.withColumn("scene_ts", F.floor((F.col("frame") - first) / 10).cast("long"))
    if part:
        cut = mapped_type(F.col("scene"), split_frame or {})
        if part == "train":
            rows = rows.filter(F.col("scene_ts") < cut)
        else:
            rows = rows.filter(F.col("scene_ts") >= cut).withColumn("scene_ts", F.col("scene_ts") - cut)
    rows = rows.withColumn("agent_id", F.col("track").cast("long").cast("string"))
    states = velocities(drop_single_detections(rows), 0.4)
    return Scenes(canonical(states.withColumns({"agent_type": F.lit(2), **dict(zip(("length", "width", "height"), map(F.lit, WALKER)))})), 0.4)


def drone(spark: SparkSession, path: str, scales: dict[str, float]) -> Scenes:
    """Space-separated boxes at 30 Hz. Generated boxes are dropped and filled linearly; a scale for each scene turns pixels to metres."""
    schema = "agent_id string, x_min double, y_min double, x_max double, y_max double, frame long, lost int, occluded int, generated int, label string"
    rows = spark.read.csv(path, sep=" ", schema=schema, quote='"').withColumn("scene", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1))
    scale = F.lit(None).cast("double")
    for scene, s in scales.items():
        scale = F.when(F.col("scene") == scene, s).otherwise(scale)
    seen = F.col("generated") == 0
    rows = rows.withColumns({
        "scene_ts": F.col("frame") - F.min("frame").over(Window.partitionBy("scene")),
        "x": F.when(seen, scale * (F.col("x_min") + F.col("x_max")) / 2), "y": F.when(seen, scale * (F.col("y_min") + F.col("y_max")) / 2),
    })
    rows = rows.withColumn("fx", interpolated("x")).withColumn("fy", interpolated("y")).drop("x", "y").withColumnsRenamed({"fx": "x", "fy": "y"})
    first = F.first("label").over(Window.partitionBy(*AGENT).orderBy("scene_ts"))
    rows = rows.filter("x IS NOT NULL").withColumns({"agent_type": mapped_type(first, DRONE_TYPES), **dict(zip(("length", "width", "height"), map(F.lit, WALKER)))})
    return Scenes(canonical(velocities(rows, 1 / 30)), 1 / 30)


def junction_cases(spark: SparkSession, path: str) -> Scenes:
    """CSV of many cases a file at 10 Hz; cases and frames count from 1 there and from 0 here. A scene is a case of a file."""
    rows = spark.read.csv(path, header=True, schema="case_id double, track_id string, frame_id long, timestamp_ms long, agent_type string, x double, y double, vx double, vy double, psi_rad double, length double, width double")
    case = F.col("case_id").cast("long") - 1
    car = F.col("agent_type") == "car"
    rows = rows.select(
        F.concat_ws("_", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1), case).alias("scene"), F.concat_ws("_", case, "track_id").alias("agent_id"),
        (F.col("frame_id") - 1).alias("scene_ts"), "x", "y", "vx", "vy", F.when(car, F.col("psi_rad")).otherwise(F.atan2("vy", "vx")).alias("heading"),
        F.when(car, 1).otherwise(2).alias("agent_type"), "length", "width",
    )
    w = Window.partitionBy(*AGENT).orderBy("scene_ts")
    vehicle = F.col("agent_type") == 1
    rows = rows.withColumns({
        "length": F.when(vehicle, F.first("length", True).over(w)).otherwise(WALKER[0]), "width": F.when(vehicle, F.first("width", True).over(w)).otherwise(WALKER[1]),
        "height": F.when(vehicle, 1.83).otherwise(WALKER[2]), "ax": F.coalesce(diff("vx") / 0.1, F.lit(0.0)), "ay": F.coalesce(diff("vy") / 0.1, F.lit(0.0)),
    })
    return Scenes(canonical(rows), 0.1)


def scenarios(spark: SparkSession, path: str) -> Scenes:
    """Scenario parquet at 10 Hz, a file each; objects of other types are left out, the recording car is ego."""
    rows = spark.read.parquet(path)
    rows = rows.filter(F.col("object_type").isin(*SCENARIO_OBJECTS)).select(
        F.col("scenario_id").alias("scene"), F.when(F.col("track_id") == "AV", "ego").otherwise(F.col("track_id")).alias("agent_id"), F.col("timestep").cast("long").alias("scene_ts"),
        F.col("position_x").alias("x"), F.col("position_y").alias("y"), F.col("velocity_x").alias("vx"), F.col("velocity_y").alias("vy"), "heading", "object_type",
    )
    rows = rows.withColumns({"ax": F.coalesce(diff("vx") / 0.1, F.lit(0.0)), "ay": F.coalesce(diff("vy") / 0.1, F.lit(0.0)), **_extent(F.col("object_type"), SCENARIO_OBJECTS)})
    return Scenes(canonical(rows), 0.1)


def timestep_of(rows: DataFrame) -> DataFrame:
    """(scene, dt): the mean step of timestamp_ms in seconds, brought to 0.1 or 0.05 when near it."""
    w = Window.partitionBy("scene", "agent_id").orderBy("timestamp_ms")
    step = rows.withColumn("_d", F.col("timestamp_ms") - F.lag("timestamp_ms").over(w)).groupBy("scene").agg(F.round(F.avg("_d") / 1000, 2).alias("dt"))
    near = lambda to: F.abs(F.col("dt") - to) < 0.02
    return step.withColumn("dt", F.when(near(0.1), 0.1).when(near(0.05), 0.05).otherwise(F.col("dt")))


def junction_tracks(rows: DataFrame, dt: float = 0.1) -> Scenes:
    """Tracks of a junction, already flat (scene, track_id, class, frame_id, x, y, vx, vy, ax, ay, heading_rad, yaw_rad, length, width).

    Pickled files hold code and are not read here; they are turned to parquet where they are trusted.
    """
    rows = rows.withColumnsRenamed({"track_id": "agent_id", "frame_id": "scene_ts"}).withColumn("agent_id", F.col("agent_id").cast("string"))
    usual = _extent(F.lower("class"), JUNCTION_OBJECTS)
    known = lambda c: F.when(F.nanvl(F.col(c), F.lit(None)) > 0, F.col(c))
    value = lambda c: F.nanvl(F.col(c), F.lit(None))
    rows = rows.withColumns({
        "heading": F.coalesce(value("heading_rad"), value("yaw_rad"), F.atan2("vy", "vx")), "agent_type": usual["agent_type"],
        "length": F.coalesce(known("length"), usual["length"]), "width": F.coalesce(known("width"), usual["width"]), "height": usual["height"],
        "ax": F.coalesce(value("ax"), diff("vx") / dt, F.lit(0.0)), "ay": F.coalesce(value("ay"), diff("vy") / dt, F.lit(0.0)),
    })
    return Scenes(canonical(rows.filter("agent_type IS NOT NULL")), dt)


def nested_tracks(scenarios_: DataFrame, types: dict[int, int], dt: float = 0.1) -> Scenes:
    """Scenarios (scene, tracks: array of id, object_type, states: array of valid, x, y, z, vx, vy, heading, length, width, height).

    States that aren't valid are missing and filled linearly between valid ones; single detections go.
    """
    track = scenarios_.select("scene", F.explode("tracks").alias("t")).select("scene", F.col("t.id").cast("string").alias("agent_id"), F.col("t.object_type").alias("o"), F.posexplode("t.states").alias("scene_ts", "s"))
    agent_type = F.lit(0)
    for code, t in types.items():
        agent_type = F.when(F.col("o") == code, t).otherwise(agent_type)
    fields = ("x", "y", "z", "vx", "vy", "heading", "length", "width", "height")
    rows = track.select("scene", "agent_id", F.col("scene_ts").cast("long").alias("scene_ts"), agent_type.alias("agent_type"), *(F.when(F.col("s.valid"), F.col(f"s.{c}")).alias(c) for c in fields))
    for c in fields:
        rows = rows.withColumn(f"_{c}", interpolated(c))
    rows = rows.drop(*fields).withColumnsRenamed({f"_{c}": c for c in fields}).filter("x IS NOT NULL")
    rows = drop_single_detections(rows).withColumns({"ax": F.coalesce(diff("vx") / dt, F.lit(0.0)), "ay": F.coalesce(diff("vy") / dt, F.lit(0.0))})
    return Scenes(canonical(rows), dt)


def log_scenes(scene: DataFrame, log: DataFrame, lidar_pc: DataFrame) -> DataFrame:
    """Scenes of a driving log with location and number of frames, 0 where there are none."""
    frames = lidar_pc.groupBy("scene_token").agg(F.count("*").alias("n"))
    found = scene.join(log.select(F.col("token").alias("log_token"), "location", "logfile"), "log_token", "left").join(frames, scene["token"] == frames["scene_token"], "left")
    return found.select(F.concat_ws("=", "logfile", F.lower(F.hex("token"))).alias("scene"), "location", F.coalesce("n", F.lit(0)).alias("length_ts"), F.col("token").alias("scene_token"))


def log_states(scenes: DataFrame, lidar_pc: DataFrame, ego_pose: DataFrame, lidar_box: DataFrame, track: DataFrame, category: DataFrame, dt: float = 0.05) -> Scenes:
    """Ego and detected agents of a driving log's tables; frames are numbered by time inside a scene."""
    w = Window.partitionBy("scene").orderBy("timestamp")
    frames = lidar_pc.join(scenes.select("scene", "scene_token"), "scene_token").withColumn("scene_ts", (F.row_number().over(w) - 1).cast("long")).select("scene", "scene_ts", F.col("token").alias("lidar_pc_token"), "ego_pose_token")
    pose = ego_pose.withColumnRenamed("token", "ego_pose_token")
    ego = frames.join(pose, "ego_pose_token", "left").select(
        "scene", F.lit("ego").alias("agent_id"), "scene_ts", "x", "y", "z", "vx", "vy", F.col("acceleration_x").alias("ax"), F.col("acceleration_y").alias("ay"),
        yaw(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")).alias("heading"), F.lit(1).alias("agent_type"), *(F.lit(v).alias(c) for c, v in zip(("length", "width", "height"), LOG_CAR)),
    )
    kinds = track.join(category.select(F.col("token").alias("category_token"), "name"), "category_token", "left").select(F.col("token").alias("track_token"), "name", "length", "width", "height")
    boxes = lidar_box.join(frames.drop("ego_pose_token"), "lidar_pc_token").join(kinds, "track_token").filter(F.col("name").isin("vehicle", "bicycle", "pedestrian"))
    agents = boxes.select("scene", F.lower(F.hex("track_token")).alias("agent_id"), "scene_ts", "x", "y", "z", "vx", "vy", F.col("yaw").alias("heading"), mapped_type(F.col("name"), {"vehicle": 1, "pedestrian": 2, "bicycle": 3}).alias("agent_type"), "length", "width", "height")
    agents = drop_single_detections(agents).withColumns({"ax": F.coalesce(diff("vx") / dt, F.lit(0.0)), "ay": F.coalesce(diff("vy") / dt, F.lit(0.0))})
    return Scenes(canonical(ego).unionByName(canonical(agents)), dt)


def log_lights(scenes: DataFrame, lidar_pc: DataFrame, lights: DataFrame) -> DataFrame:
    """(scene, lane_id, scene_ts, status) of a driving log."""
    w = Window.partitionBy("scene").orderBy("timestamp")
    frames = lidar_pc.join(scenes.select("scene", "scene_token"), "scene_token").withColumn("scene_ts", (F.row_number().over(w) - 1).cast("long"))
    return frames.select("scene", "scene_ts", F.col("token").alias("lidar_pc_token")).join(lights, "lidar_pc_token").select("scene", F.col("lane_connector_id").cast("string").alias("lane_id"), "scene_ts", mapped_type(F.lower("status"), LIGHT_CODES).alias("status"))


#: States of a signal's lane in the nested tracks: going, and stopping or to stop, with arrow or without, flashing included. Fixed values.
GOING, STOPPING = (3, 6), (1, 2, 4, 5, 7, 8)


def nested_lights(scenes: DataFrame) -> DataFrame:
    """(scene, lane_id, scene_ts, status) of ``scenes`` (scene, dynamic_states: an array by timestep of structs with lane_states, an array of lane and state).

    Caution counts as red, unknown and null states as unknown. Of several states of a lane in one timestep the last one counts; lanes that are null are left out.
    """
    step = scenes.select("scene", F.posexplode("dynamic_states").alias("scene_ts", "d")).select("scene", F.col("scene_ts").cast("long").alias("scene_ts"), F.posexplode("d.lane_states").alias("k", "s"))
    known = F.when(F.col("s.state").isin(*GOING), LIGHT_CODES["green"]).when(F.col("s.state").isin(*STOPPING), LIGHT_CODES["red"]).otherwise(0)
    rows = step.filter("s.lane IS NOT NULL").select("scene", F.col("s.lane").cast("string").alias("lane_id"), "scene_ts", "k", known.alias("status"))
    return rows.groupBy("scene", "lane_id", "scene_ts").agg(F.max_by("status", "k").alias("status"))


def annotated_samples(sample: DataFrame, annotation: DataFrame, ego: DataFrame, types: dict[str, int], dt: float) -> Scenes:
    """Linked samples (token, scene, timestamp), annotations (sample_token, instance_token, category_name, x, y, z, qw, qx, qy, qz, length, width, height)
    and ego poses (sample_token, x, y, z, qw, qx, qy, qz). Samples with a column ``next`` are numbered by following it from each scene's first one, others by time; gaps are filled linearly.

    Categories are matched by prefix; others and the ego's own category are left out.
    """
    from ..operators.derive import fill_gaps, unwrap

    if "next" in sample.columns:
        numbered = sample.join(ranked(sample), "token").withColumn("scene_ts", F.col("rank"))
    else:
        numbered = sample.withColumn("scene_ts", (F.row_number().over(Window.partitionBy("scene").orderBy("timestamp")) - 1).cast("long"))
    frames = numbered.filter("scene_ts IS NOT NULL").select("scene", "scene_ts", F.col("token").alias("sample_token"))
    kind = F.lit(None).cast("int")
    for prefix, t in types.items():
        kind = F.when(F.col("category_name").startswith(prefix), t).otherwise(kind)
    heading = yaw(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")).alias("heading")
    found = annotation.filter("category_name <> 'vehicle.ego'").withColumn("agent_type", kind).filter("agent_type IS NOT NULL").join(frames, "sample_token")
    agents = drop_single_detections(found.select("scene", F.col("instance_token").alias("agent_id"), "scene_ts", "x", "y", "z", heading, "agent_type", "length", "width", "height"))
    own = ego.join(frames, "sample_token").select("scene", F.lit("ego").alias("agent_id"), "scene_ts", "x", "y", "z", heading, F.lit(1).alias("agent_type"), *(F.lit(v).alias(c) for c, v in zip(("length", "width", "height"), SAMPLE_CAR)))
    every = unwrap(agents.unionByName(own), out="heading_unwrapped")
    constant = every.groupBy(*AGENT).agg(*(F.min_by(c, "scene_ts").alias(c) for c in ("agent_type", "length", "width", "height")))
    filled = fill_gaps(every, "x", "y", "z", "heading_unwrapped").drop("filled").join(constant, list(AGENT))
    from ..functions.angles import wrap

    return Scenes(canonical(velocities(filled.withColumn("heading", wrap(F.col("heading_unwrapped"))), dt)), dt)


def frame_intervals(scenes: DataFrame, frames: DataFrame, agents: DataFrame, types: list[int], dt: float = 0.1) -> Scenes:
    """Scenes and frames that point at ranges of rows: scenes (scene, first_frame, end_frame), frames (frame, first_agent, end_agent, ego x, y, z, heading),
    agents (row, track_id, x, y, vx, vy, yaw, length, width, height, probabilities). The most probable label of a track's rows wins, by mode.

    Ranges become rows, so the joins are equi-joins.
    """
    from ..operators.derive import mode_by_agent

    w = Window.partitionBy("scene").orderBy("frame")
    own = scenes.select("scene", F.explode(F.sequence("first_frame", F.col("end_frame") - 1)).alias("frame")).withColumn("scene_ts", (F.row_number().over(w) - 1).cast("long")).join(frames, "frame")
    ego = velocities(own.select("scene", F.lit("ego").alias("agent_id"), "scene_ts", "x", "y", "z", "heading", F.lit(1).alias("agent_type"), *(F.lit(v).alias(c) for c, v in zip(("length", "width", "height"), INTERVAL_CAR))), dt)
    some = own.filter("end_agent > first_agent").select("scene", "scene_ts", "z", F.explode(F.sequence("first_agent", F.col("end_agent") - 1)).alias("row"))
    seen = some.join(agents, "row").withColumns({"agent_id": F.col("track_id").cast("string"), "label": F.array_position("probabilities", F.array_max("probabilities")).cast("int")})
    label = mode_by_agent(seen, "label")
    kind = F.element_at(F.array(*map(F.lit, types)), F.col("label"))
    rows = drop_single_detections(seen.drop("label")).join(label, list(AGENT)).withColumns({"agent_type": kind, "heading": F.col("yaw"), "ax": F.coalesce(diff("vx") / dt, F.lit(0.0)), "ay": F.coalesce(diff("vy") / dt, F.lit(0.0))})
    return Scenes(canonical(ego).unionByName(canonical(rows)), dt)
