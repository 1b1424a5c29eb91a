import json
import math

import pytest
from pyspark.sql import functions as F

from kinelog.operators import maps as map_operators
from kinelog.sources import maps, metadata, registry, sinks, store, tracks
from kinelog.sources.common import STATES


def test_walkers(spark, tmp_path):
    (tmp_path / "hall.txt").write_text("\n".join(f"{780 + 10 * t}.0\t{a}.0\t{t * 0.4}\t{a}.0" for a in (1, 2) for t in range(5)) + "\n780.0\t9.0\t0.0\t0.0\n")
    s = tracks.walkers(spark, str(tmp_path))
    assert s.dt == 0.4 and s.states.columns == list(STATES)
    rows = s.states.orderBy("agent_id", "scene_ts").collect()
    assert [(r.scene, r.agent_id, r.scene_ts) for r in rows] == [("hall", a, t) for a in "12" for t in range(5)]
    assert all(r.vx == pytest.approx(1.0) and r.ax == pytest.approx(0.0, abs=1e-9) and r.heading == pytest.approx(0.0) for r in rows)
    late = tracks.walkers(spark, str(tmp_path), "val", {"hall": 3}).states
    assert {r.scene_ts for r in late.collect()} == {0, 1}
    assert {r.agent_type: (r.length, r.height) for r in s.agents().collect()} == {2: (0.75, 1.5)}


def test_drone(spark, tmp_path):
    (tmp_path / "quad_0").mkdir()
    lines = [f'5 {10 * t} 0 {10 * t + 2} 4 {100 + t} 0 0 {int(t in (2, 3))} "Biker"' for t in range(6)]
    lines[2] = '5 999 0 999 4 102 0 0 1 "Biker"'
    (tmp_path / "quad_0" / "annotations.txt").write_text("\n".join(lines))
    rows = tracks.drone(spark, f"{tmp_path}/*/annotations.txt", {"quad_0": 0.1}).states.orderBy("scene_ts").collect()
    assert [r.x for r in rows] == pytest.approx([0.1 * (10 * t + 1) for t in range(6)]) and {r.agent_type for r in rows} == {3}


def test_junction_cases(spark, tmp_path):
    head = "case_id,track_id,frame_id,timestamp_ms,agent_type,x,y,vx,vy,psi_rad,length,width\n"
    (tmp_path / "USA_x.csv").write_text(head + "1.0,P1,1,100,pedestrian/bicycle,0,0,0,2,,,\n1.0,P1,2,200,pedestrian/bicycle,0,0.2,0,3,,,\n2.0,7,1,100,car,0,0,1,0,0.5,4.1,1.9\n")
    rows = {(r.scene, r.agent_id, r.scene_ts): r for r in tracks.junction_cases(spark, str(tmp_path)).states.collect()}
    assert set(rows) == {("USA_x_0", "0_P1", 0), ("USA_x_0", "0_P1", 1), ("USA_x_1", "1_7", 0)}
    a, b = rows["USA_x_0", "0_P1", 0], rows["USA_x_1", "1_7", 0]
    assert a.heading == pytest.approx(math.pi / 2) and a.ay == pytest.approx(10.0) and (a.agent_type, a.length) == (2, 0.75)
    assert (b.heading, b.length, b.height, b.ax) == (0.5, 4.1, 1.83, 0.0)


def test_scenarios(spark, tmp_path):
    rows = [("s", "AV", "vehicle", t, float(t), 0.0, 10.0, 0.0, 0.1) for t in range(3)] + [("s", "4", "static", 0, 0.0, 0.0, 0.0, 0.0, 0.0), ("s", "5", "cyclist", 1, 0.0, 0.0, 1.0, 0.0, 0.0)]
    spark.createDataFrame(rows, "scenario_id string, track_id string, object_type string, timestep long, position_x double, position_y double, velocity_x double, velocity_y double, heading double").write.parquet(f"{tmp_path}/p")
    got = {(r.agent_id, r.scene_ts): r for r in tracks.scenarios(spark, f"{tmp_path}/p").states.collect()}
    assert set(got) == {("ego", 0), ("ego", 1), ("ego", 2), ("5", 1)} and got["5", 1].agent_type == 3 and got["ego", 0].length == 4.0


def test_junction_tracks_and_their_timestep(spark):
    nan = float("nan")
    kind = "scene string, track_id long, class string, frame_id long, timestamp_ms double, x double, y double, vx double, vy double, ax double, ay double, heading_rad double, yaw_rad double, length double, width double"
    rows = [("s", 1, "Car", t, t * 100.1, 0.0, 0.0, 1.0 + t, 1.0, nan, 0.0, nan, None if t else 0.3, nan, -1.0) for t in range(3)] + [("s", 2, "ghost", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, kind)
    got = tracks.junction_tracks(df).states.orderBy("scene_ts").collect()
    assert len(got) == 3 and got[0].heading == 0.3 and got[1].heading == pytest.approx(math.atan2(1, 2)) and got[0].ax == pytest.approx(10.0) and (got[0].length, got[0].width) == (4.5, 2.0)
    assert tracks.timestep_of(df.withColumn("agent_id", F.col("track_id"))).first().dt == 0.1


def test_nested_tracks(spark):
    state = "struct<valid:boolean,x:double,y:double,z:double,vx:double,vy:double,heading:double,length:double,width:double,height:double>"
    make = lambda ok, x: (ok, x, 0.0, 0.0, 1.0, 0.0, 0.0, 4.0, 2.0, 1.5)
    rows = [("s", [(7, 1, [make(False, -1.0), make(True, 1.0), make(False, 99.0), make(True, 3.0), make(False, -1.0)]), (8, 2, [make(True, 0.0)])])]
    df = spark.createDataFrame(rows, f"scene string, tracks array<struct<id:long,object_type:int,states:array<{state}>>>")
    got = tracks.nested_tracks(df, {1: 1, 2: 2}).states.orderBy("scene_ts").collect()
    assert [(r.agent_id, r.scene_ts, r.x) for r in got] == [("7", 1, 1.0), ("7", 2, 2.0), ("7", 3, 3.0)]


def test_driving_log(spark):
    frame = spark.createDataFrame
    token = lambda i: bytearray([i])
    scene = frame([(token(1), token(9)), (token(2), token(8))], "token binary, log_token binary")
    log = frame([(token(9), "pit", "f")], "token binary, location string, logfile string")
    pcs = frame([(token(20 + i), token(1), token(40 + i), 1000 - i) for i in range(3)], "token binary, scene_token binary, ego_pose_token binary, timestamp long")
    pose = frame([(token(40 + i), float(i), 0.0, 0.0, math.cos(0.25), 0.0, 0.0, math.sin(0.25), 1.0, 0.0, 0.0, 0.0) for i in range(3)], "token binary, x double, y double, z double, qw double, qx double, qy double, qz double, vx double, vy double, acceleration_x double, acceleration_y double")
    box = frame([(token(20 + i), token(60), 1.0 * i, 0.0, 0.0, 1.0 + i, 0.0, 0.1) for i in range(3)] + [(token(20), token(61), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (token(20), token(62), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "lidar_pc_token binary, track_token binary, x double, y double, z double, vx double, vy double, yaw double")
    track = frame([(token(60), token(70), 2.0, 4.0, 1.5), (token(61), token(70), 2.0, 4.0, 1.5), (token(62), token(71), 1.0, 1.0, 1.0)], "token binary, category_token binary, width double, length double, height double")
    category = frame([(token(70), "vehicle"), (token(71), "barrier")], "token binary, name string")
    scenes = tracks.log_scenes(scene, log, pcs)
    assert sorted((r.scene, r.length_ts) for r in scenes.collect()) == [("02", 0), ("f=01", 3)]
    rows = {(r.agent_id, r.scene_ts): r for r in tracks.log_states(scenes, pcs, pose, box, track, category).states.collect()}
    assert set(rows) == {("ego", t) for t in range(3)} | {("3C".lower(), t) for t in range(3)}
    assert rows["ego", 0].x == 2.0 and rows["ego", 0].heading == pytest.approx(0.5) and rows["3c", 0].ax == pytest.approx(-20.0)
    lights = frame([(token(22), 5, "green")], "lidar_pc_token binary, lane_connector_id long, status string")
    assert [tuple(r) for r in tracks.log_lights(scenes, pcs, lights).collect()] == [("f=01", "5", 0, 1)]


def test_annotated_samples(spark):
    frame = spark.createDataFrame
    sample = frame([(f"t{i}", "s", i) for i in range(4)], "token string, scene string, timestamp long")
    q = (math.cos(0.1), 0.0, 0.0, math.sin(0.1))
    ann = frame([(f"t{i}", "a", "vehicle.car", float(i), 0.0, 0.0, *q, 4.0, 2.0, 1.5) for i in (0, 1, 3)] + [("t0", "b", "animal", 0.0, 0.0, 0.0, *q, 1.0, 1.0, 1.0), ("t0", "c", "human.adult", 0.0, 0.0, 0.0, *q, 1.0, 1.0, 1.0)], "sample_token string, instance_token string, category_name string, x double, y double, z double, qw double, qx double, qy double, qz double, length double, width double, height double")
    ego = frame([(f"t{i}", 2.0 * i, 0.0, 0.0, *q) for i in range(4)], "sample_token string, x double, y double, z double, qw double, qx double, qy double, qz double")
    rows = {(r.agent_id, r.scene_ts): r for r in tracks.annotated_samples(sample, ann, ego, {"vehicle": 1, "human": 2}, 0.5).states.collect()}
    assert set(rows) == {(a, t) for a in ("a", "ego") for t in range(4)}
    assert rows["a", 2].x == 2.0 and rows["a", 2].vx == pytest.approx(2.0) and rows["ego", 0].vx == pytest.approx(4.0) and rows["a", 2].heading == pytest.approx(0.2)
    own = rows["ego", 0]
    assert (own.length, own.width, own.height) == (4.084, 1.730, 1.562)
    # Links tell the order where times tie, are missing or wrong; samples of a ring have no place.
    linked = frame([(f"t{i}", "s", None if i == 2 else 0, f"t{i + 1}" if i < 3 else None) for i in range(4)] + [("r", "s", 9, "r")], "token string, scene string, timestamp long, next string")
    again = {(r.agent_id, r.scene_ts): r for r in tracks.annotated_samples(linked, ann, ego, {"vehicle": 1, "human": 2}, 0.5).states.collect()}
    assert again == rows


def test_frame_intervals(spark):
    frame = spark.createDataFrame
    scenes = frame([("s", 10, 12)], "scene string, first_frame long, end_frame long")
    frames = frame([(10, 0, 2, 0.0, 0.0, 5.0, 0.0), (11, 2, 3, 1.0, 0.0, 5.0, 0.0)], "frame long, first_agent long, end_agent long, x double, y double, z double, heading double")
    agents = frame([(0, 1, 0.0, 0.0, 1.0, 0.0, 0.0, 4.0, 2.0, 1.5, [0.1, 0.9]), (1, 2, 0.0, 0.0, 1.0, 0.0, 0.0, 4.0, 2.0, 1.5, [0.9, 0.1]), (2, 1, 0.1, 0.0, 2.0, 0.0, 0.0, 4.0, 2.0, 1.5, [0.2, 0.8])], "row long, track_id long, x double, y double, vx double, vy double, yaw double, length double, width double, height double, probabilities array<double>")
    rows = {(r.agent_id, r.scene_ts): r for r in tracks.frame_intervals(scenes, frames.withColumnsRenamed({"x": "x", "y": "y"}), agents.drop("z"), [1, 2]).states.collect()}
    assert set(rows) == {("ego", 0), ("ego", 1), ("1", 0), ("1", 1)} and rows["1", 0].agent_type == 2 and rows["1", 0].z == 5.0 and rows["1", 1].ax == pytest.approx(10.0)
    own = rows["ego", 1]
    assert (own.length, own.width, own.height) == (4.869, 1.852, 1.476)


def test_lanelets(spark, tmp_path):
    nodes = [(10 * w + i, 1e-5 * w, 1e-4 * i) for w in (1, 2, 3) for i in range(3)]
    lanes = [(100, 1, 2, "road"), (101, 2, 3, "road"), (102, 1, 3, "crosswalk")]
    osm = "".join(f'<node id="{n}" lat="{a}" lon="{b}" />\n' for n, a, b in nodes)
    osm += "".join(f'<way id="{w}">' + "".join(f'<nd ref="{10 * w + i}" />' for i in range(3)) + '<tag k="type" v="line" /></way>\n' for w in (1, 2, 3))
    osm += "".join(f'<relation id="{r}"><member type="way" role="left" ref="{a}" /><member type="way" role="right" ref="{b}" /><tag k="type" v="lanelet" /><tag k="subtype" v="{k}" /></relation>\n' for r, a, b, k in lanes)
    (tmp_path / "m.osm").write_text(f'<?xml version="1.0"?>\n<osm version="0.6">\n{osm}</osm>\n')
    t = maps.lanelet_tables(spark, f"{tmp_path}/m.osm")
    assert (t["nodes"].count(), t["way_nodes"].count(), t["lanelets"].count()) == (9, 9, 3)
    centers = maps.lanelet_centers(maps.lanelet_points(t, "m")).filter("elem_id = 100").orderBy("seq").collect()
    assert [r.y for r in centers] == pytest.approx([1.6586] * 3, abs=0.01) and [r.x for r in centers] == pytest.approx([0.0, 11.13, 22.26], abs=0.01)
    assert all(r.h == pytest.approx(0.0, abs=1e-3) for r in centers)
    near = map_operators.adjacent_by_border(maps.lanelet_borders(t))
    assert sorted(map(tuple, near.collect())) == [(100, 101), (101, 100)]


def test_crosswalks_of_lanelets(spark):
    at = {1: (0, 0), 2: (0, 2), 3: (1, 2), 4: (1, 0), 5: (0, 1), 6: (1, 1), 7: (0, 3)}
    ways = {10: (1, 5, 2), 11: (3, 6, 4), 12: (1, 2, 7), 13: ()}  # 11 runs the other way, 12 lies in line with 10
    tables = {
        "nodes": spark.createDataFrame([(n, a * 1e-4, b * 1e-4) for n, (a, b) in at.items()], "id long, lat double, lon double"),
        "way_nodes": spark.createDataFrame([(w, k, n) for w, ns in ways.items() for k, n in enumerate(ns)], "way long, seq int, node long"),
        "lanelets": spark.createDataFrame([
            (1, 10, 11, "crosswalk", "zebra"), (2, 11, 10, "crosswalk", None), (3, 10, None, "crosswalk", "half"), (4, 10, 12, "crosswalk", "flat"), (5, 10, 13, "crosswalk", "bare"), (6, 10, 11, "road", "road"),
        ], "id long, left_way long, right_way long, subtype string, name string"),
    }
    points = maps.lanelet_crosswalks(tables, "m")
    rows = maps.rings(points).collect()
    assert sorted(r.elem_id for r in rows) == ["2", "zebra"]
    for r in rows:
        corners = [(round(p.x / 11.13), round(p.y / 11.06)) for p in r.polygon]
        assert corners == [(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)] and r.holes == []
    assert {r.elem_type for r in points.collect()} == {3}
    assert maps.lanelet_crosswalks({**tables, "lanelets": tables["lanelets"].limit(0)}, "m").count() == 0


def test_outlines(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"drivable_area": [[[0, 0], [4, 0], [4, 4]]], "pedestrian_area": [], "road_divider": [[[0, 0], [0, 2]]], "lane_divider": []}))
    p = maps.outlines(spark, f"{tmp_path}/m.json", "m")
    assert p.filter("elem_type = 2").count() == 4 and p.filter("elem_id = 'road_divider_0'").first().h == pytest.approx(math.pi / 2)
    assert [r.elem_id for r in maps.rings(p).collect()] == ["drivable_area_0"]


def test_registry_and_tags():
    assert registry.reader("nusc_mini")[0] is tracks.annotated_samples
    with pytest.raises(ValueError):
        registry.reader("nothing")
    assert registry.scene_tags("e", [["train", "val"], ["a", "b"]]) == [["e", "train", "a"], ["e", "train", "b"], ["e", "val", "a"], ["e", "val", "b"]]


def test_states_on_disk_and_at_another_timestep(spark, tmp_path):
    (tmp_path / "hall.txt").write_text("\n".join(f"{10 * t}.0\t{a}.0\t{t * 0.4}\t{a}.0" for a in (1, 2) for t in range(5)))
    s = tracks.walkers(spark, f"{tmp_path}/hall.txt")
    for _ in range(2):
        sinks.save_states(s.states, f"{tmp_path}/out", "eupeds", 0.4)
    assert sinks.read_states(spark, f"{tmp_path}/out", "eupeds", 0.4).count() == 10
    up = sinks.states_at(spark, f"{tmp_path}/out", "eupeds", 0.4, 0.2)
    assert up.count() == 18 and sinks.states_at(spark, f"{tmp_path}/out", "eupeds", 0.4, 0.2).count() == 18
    assert "PartitionFilters: [" in up._jdf.queryExecution().executedPlan().toString()


def test_columns_survive_another_timestep(spark, tmp_path):
    (tmp_path / "hall.txt").write_text("\n".join(f"{10 * t}.0\t{a}.0\t{t * 0.4}\t{a}.0" for a in (1, 2) for t in range(5)))
    s = tracks.walkers(spark, f"{tmp_path}/hall.txt")
    sinks.save_states(s.states, f"{tmp_path}/out", "eupeds", 0.4)
    for dt, n in ((0.2, 18), (0.8, 6)):
        found = sinks.states_at(spark, f"{tmp_path}/out", "eupeds", 0.4, dt)
        assert set(found.columns) == {*s.states.columns, "env", "dt"}
        assert [r.agent_type for r in found.collect()] == [2] * n and {r.length for r in found.collect()} == {0.75}


def test_center_lines_have_all_points(spark):
    border = lambda side, n, y: [("m", 1, side, i, 10.0 * i / (n - 1), y, 0.0) for i in range(n)]
    rows = border("left", 101, 2.0) + border("right", 34, 0.0) + [("m", 2, "left", i, float(i), 0.0, 0.0) for i in range(3)] + [("m", 3, s, i, 5.0, 5.0, 0.0) for s in ("left", "right") for i in range(2)]
    points = spark.createDataFrame(rows, "map_id string, elem_id long, side string, seq int, x double, y double, z double")
    got = maps.lanelet_centers(points).orderBy("elem_id", "seq").collect()
    one = [r for r in got if r.elem_id == 1]
    assert [r.seq for r in one] == list(range(101)) and [r.x for r in one] == pytest.approx([i / 10 for i in range(101)]) and {round(r.y, 9) for r in one} == {1.0}
    assert [(r.elem_id, r.x, r.y) for r in got if r.elem_id > 1] == [(3, 5.0, 5.0)] * 2  # a lanelet with one border has no center line


def test_stored_tables(spark, tmp_path):
    path, made = str(tmp_path / "index"), []

    def make():
        made.append(1)
        return spark.range(5).withColumnRenamed("id", "k")

    for _ in range(2):
        assert store.stored(spark, path, {"b": 1, "a": [2]}, make).count() == 5
    assert made == [1] and store.key_of({"a": [2], "b": 1}) == store.key_of({"b": 1, "a": [2]}) != store.key_of({"b": 2, "a": [2]})
    assert store.stored_elements(spark, path, {"b": 1, "a": [2]}, make, spark.range(9).withColumnRenamed("id", "k"), ("k",)).count() == 5
    with pytest.raises(ValueError):
        store.stored_elements(spark, path, {"b": 1, "a": [2]}, make, spark.range(3).withColumnRenamed("id", "k"), ("k",))
    lanes = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("b", 3, 1)], "map_id string, elem_id int, elem_type int")
    store.save_maps(lanes, f"{tmp_path}/maps")
    store.save_maps(lanes.filter("map_id = 'b'").withColumn("elem_id", F.lit(9)), f"{tmp_path}/maps")
    assert [r.elem_id for r in store.read_map(spark, f"{tmp_path}/maps", "a", ("ped_crosswalk",)).collect()] == [2]
    assert [r.elem_id for r in store.read_map(spark, f"{tmp_path}/maps", "b").collect()] == [9]
    with pytest.raises(ValueError):
        store.read_map(spark, f"{tmp_path}/maps", "c")


def test_edges_from_an_outline(spark):
    kind = "map_id string, elem_id long, seq int, x double, y double, z double"
    center = spark.createDataFrame([("m", 1, i, x, 0.0, 0.0) for i, x in enumerate((0.0, 0.0, 2.0, 4.0, 6.0))], kind)
    # Against the clock from the lower left, three points below and five above.
    ring = [(0.0, -1.0), (3.0, -1.0), (6.0, -1.0), (6.0, 1.0), (4.5, 1.0), (3.0, 1.0), (1.5, 1.0), (0.0, 1.0)]
    for turn in range(len(ring)):
        outline = spark.createDataFrame([("m", 1, i, *p, 0.0) for i, p in enumerate(ring[turn:] + ring[:turn])], kind)
        got = {}
        for r in maps.edges_from_polygons(outline, center).orderBy("side", "seq").collect():
            got.setdefault(r.side, []).append((r.x, r.y))
        assert got == {"left": [(x, 1.0) for x in (0.0, 1.5, 3.0, 4.5, 6.0)], "right": [(x, -1.0) for x in (0.0, 1.5, 3.0, 4.5, 6.0)]}
        if turn == 3:
            break


def test_assembled_map_elements(spark):
    rows = [("m", 1, 1, line, 0, i, float(i), y, 0.0) for line, y in (("center", 0.0), ("left_edge", 1.0)) for i in range(3)]
    rows += [("m", 2, 2, "polygon", ring, i, *p, 0.0) for ring, scale in ((0, 10.0), (1, 1.0), (2, 2.0)) for i, p in enumerate(((0.0, 0.0), (scale, 0.0), (scale, scale)))]
    got = {r.elem_id: r for r in maps.assembled(spark.createDataFrame(rows, "map_id string, elem_id long, elem_type int, line string, ring int, seq int, x double, y double, z double")).collect()}
    assert [p.x for p in got[1].center] == [0.0, 1.0, 2.0] and got[1].center[2].h == 0.0 and got[1].left_edge[0].y == 1.0 and got[1].right_edge is None and got[1].holes == []
    assert len(got[2].polygon) == 3 and [h[1].x for h in got[2].holes] == [1.0, 2.0] and got[2].center is None


def test_metadata_and_splits(spark):
    m = metadata.of("nusc_mini", parts=[["mini_train", "mini_val"], ["boston", "singapore"]], splits=metadata.inverted({"mini_train": ["a", "b"], "mini_val": ["c"]}))
    assert (m.dt, m.has_maps, m.apart) == (0.5, True, False) and m.tags()[0] == ["nusc_mini", "mini_train", "boston"] and len(m.tags()) == 4
    assert [tuple(r) for r in m.split_table(spark).orderBy("name").collect()] == [("a", "mini_train"), ("b", "mini_train"), ("c", "mini_val")]
    assert metadata.with_validation({"train": ["a", "b", "c"], "val": ["d"]}, 2) == {"train": ["c"], "train_val": ["a", "b"], "val": ["d"]}
    halls = metadata.inverted(metadata.one_left_out(["eth", "hotel", "zara"], ["eth"]))
    assert halls == {"eth_train": "train", "eth_val": "val", "hotel_train": "train_loo", "zara_train": "train_loo", "hotel_val": "val_loo", "zara_val": "val_loo", "eth": "test_loo"}
    assert metadata.of("eupeds_eth", more_tags=[["train_loo"]]).tags() == [["eupeds_eth"], ["eupeds_eth", "train_loo"]]
    with pytest.raises(ValueError):
        metadata.of("nothing")


def test_reading_by_name(spark, tmp_path):
    (tmp_path / "hall.txt").write_text("\n".join(f"{10 * t}.0\t{a}.0\t{t * 0.4}\t{a}.0" for a in (1, 2) for t in range(5)))
    assert registry.tables_of("eupeds_eth") == ["spark", "path"] and registry.tables_of("nusc_mini") == ["sample", "annotation", "ego", "types", "dt"]
    assert registry.read("eupeds_eth", spark=spark, path=f"{tmp_path}/hall.txt").states.count() == 10
    with pytest.raises(ValueError, match="missing"):
        registry.read("eupeds_eth", spark=spark)
    with pytest.raises(ValueError, match="unknown"):
        registry.read("eupeds_eth", spark=spark, path="x", wrong=1)


def test_lights_of_nested_tracks(spark):
    kind = "scene string, dynamic_states array<struct<lane_states: array<struct<lane: long, state: int>>>>"
    steps = [([(7, 6), (8, 4), (8, 3)],), (None,), ([(7, 5), (9, None), (None, 6), (10, 0), (11, 8)],), ([],)]
    got = tracks.nested_lights(spark.createDataFrame([("a", steps), ("b", None), ("c", [])], kind))
    assert sorted(map(tuple, got.select("scene", "lane_id", "scene_ts", "status").collect())) == [("a", "10", 2, 0), ("a", "11", 2, 2), ("a", "7", 0, 1), ("a", "7", 2, 2), ("a", "8", 0, 1), ("a", "9", 2, 0)]


def test_maps_of_some_locations_alone(spark, tmp_path):
    store.save_maps(spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 3)], "map_id string, elem_type int, elem_id long"), str(tmp_path), ["a", "c", "none"])
    assert sorted(r.map_id for r in spark.read.parquet(str(tmp_path)).collect()) == ["a", "c"]


def test_boxes_of_a_long_table(spark):
    from kinelog.operators import scenes

    long = spark.createDataFrame([(0, 1, 5, 2.0, 3.0, 0.0), (0, 1, 9, 0.0, 0.0, 0.0)], "scene long, agent_id long, of_agent long, x double, y double, heading double")
    agents = spark.createDataFrame([(0, 5, 1, 4.0, 2.0)], "scene long, agent_id long, agent_type int, length double, width double")
    got = {r.of_agent: r for r in scenes.boxes(long, agents).collect()}
    assert [tuple(c) for c in got[5].corners] == [(4.0, 4.0), (0.0, 4.0), (0.0, 2.0), (4.0, 2.0)] and got[5].agent_type == 1
    assert len(got) == 2 and got[9].agent_type is None
