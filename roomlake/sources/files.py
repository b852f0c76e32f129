"""Readers of scene files: JSON scenes and floor plans, masks, point clouds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double,z:double>"
SCENE = (
    "scene_id string, scene_type string, room_bounds array<double>, "
    "objects array<struct<id:string,label:string,type:string,x:double,y:double,z:double,rotation_z:double,width:double,length:double,height:double,n_gaussians:bigint>>, "
    "cameras array<struct<name:string,position:array<double>,look_at:array<double>,horizontal_fov_deg:double,edge_direction:string,step_direction:string,step_from:string,room_name:string>>"
)
PLAN = (
    f"id string, rooms array<struct<id:string,room_type:string,position:{POINT},dimensions:struct<width:double,length:double,height:double>,ceiling_height:double,"
    f"walls:array<struct<id:string,start_point:{POINT},end_point:{POINT},height:double,thickness:double>>,"
    "doors:array<struct<id:string,wall_id:string,position_on_wall:double,width:double,height:double,door_type:string>>,"
    "windows:array<struct<id:string,wall_id:string,position_on_wall:double,width:double,height:double,sill_height:double>>,"
    f"objects:array<struct<id:string,room_id:string,type:string,description:string,position:{POINT},rotation:{POINT},dimensions:struct<width:double,length:double,height:double>,place_id:string>>>>"
)


def read_scenes(spark: SparkSession, path: str, min_max_bounds: bool = True) -> dict[str, DataFrame]:
    """objects, cameras and rooms of scene.json files.

    ``min_max_bounds``: room_bounds are x_min, y_min, x_max, y_max, z_max; else origin and extents.
    """
    scenes = spark.read.schema(SCENE).json(path, multiLine=True)
    objects = scenes.select("scene_id", F.posexplode("objects").alias("ord", "o")).select("scene_id", "o.id", "ord", F.coalesce("o.type", "o.label").alias("type"), "o.x", "o.y", "o.z", F.coalesce("o.width", F.lit(0.5)).alias("width"), F.coalesce("o.length", F.lit(0.5)).alias("length"), F.coalesce("o.height", F.lit(0.5)).alias("height"), F.coalesce("o.rotation_z", F.lit(0.0)).alias("rotation_z"))
    c = scenes.select("scene_id", F.posexplode("cameras").alias("ord", "c"))
    at = lambda field, i: F.get(f"c.{field}", F.lit(i))
    kind = F.when(F.col("c.step_from").isNotNull(), "step").when(F.col("c.edge_direction").isNotNull(), "edge").otherwise("corner")
    cameras = c.select("scene_id", "c.name", "ord", kind.alias("kind"), *(at("position", i).alias(f"p{a}") for i, a in enumerate("xyz")), *(at("look_at", i).alias(f"l{a}") for i, a in enumerate("xyz")), F.coalesce("c.horizontal_fov_deg", F.lit(82.0)).alias("hfov"), "c.edge_direction", "c.step_direction", "c.step_from")
    b = [F.get("room_bounds", F.lit(i)) for i in range(5)]
    x1, y1 = (b[2], b[3]) if min_max_bounds else (b[0] + b[2], b[1] + b[3])
    rooms = scenes.select("scene_id", b[0].alias("x_min"), b[1].alias("y_min"), x1.alias("x_max"), y1.alias("y_max"), b[4].alias("z_max"))
    return {"objects": objects, "cameras": cameras, "rooms": rooms}


def read_plans(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """objects, rooms, walls, doors and windows of floor-plan JSON; sizes default to half a metre."""
    plans = spark.read.schema(PLAN).json(path, multiLine=True)
    rooms = plans.select(F.col("id").alias("scene_id"), F.posexplode_outer("rooms").alias("room_index", "r"))
    objects = rooms.select("scene_id", "room_index", F.posexplode("r.objects").alias("object_index", "o")).select(
        "scene_id", "o.id", (F.col("room_index") * 100000 + F.col("object_index")).alias("ord"), "o.type", "o.position.x", "o.position.y", "o.position.z",
        *(F.coalesce(f"o.dimensions.{k}", F.lit(0.5)).alias(k) for k in ("width", "length", "height")), F.coalesce("o.rotation.z", F.lit(0.0)).alias("rotation_z"), "o.place_id", "room_index", "object_index", "o.description")
    first = rooms.filter("room_index = 0 or room_index is null")
    x, y = (F.coalesce(f"r.position.{k}", F.lit(0.0)) for k in ("x", "y"))
    w, l, h = (F.coalesce(f"r.dimensions.{k}", F.lit(v)) for k, v in (("width", 5.0), ("length", 7.0), ("height", 2.7)))
    bounds = first.select("scene_id", x.alias("x_min"), y.alias("y_min"), (x + w).alias("x_max"), (y + l).alias("y_max"), h.alias("z_max"))
    parts = {k: rooms.select("scene_id", F.col("r.id").alias("room_id"), F.explode(f"r.{k}").alias("p")).select("scene_id", "room_id", "p.*") for k in ("walls", "doors", "windows")}
    return {"objects": objects, "rooms": bounds, **parts}


def plan_tables(plans: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The relations ``walls`` and ``openings`` of what read_plans gives, for evaluate().

    Doors come before windows, in the order of rooms and lists; a door of type opening is a plain opening.
    """
    w, rooms = plans["walls"], plans["rooms"].select("scene_id", ((F.col("x_min") + F.col("x_max")) / 2).alias("room_x"), ((F.col("y_min") + F.col("y_max")) / 2).alias("room_y"))
    walls = w.select("scene_id", F.col("id").alias("wall_id"), F.col("start_point.x").alias("x0"), F.col("start_point.y").alias("y0"), F.col("end_point.x").alias("x1"), F.col("end_point.y").alias("y1"), "height", "thickness").join(rooms, "scene_id")
    kind = F.when(F.col("door_type") == "opening", "opening").otherwise("door")
    common = ("position_on_wall", "width", "height")
    doors = plans["doors"].select("scene_id", "wall_id", "room_id", "id", kind.alias("kind"), *common, F.lit(0.0).alias("sill"))
    windows = plans["windows"].select("scene_id", "wall_id", "room_id", "id", F.lit("window").alias("kind"), *common, F.col("sill_height").alias("sill"))
    line = Window.partitionBy("scene_id").orderBy(F.col("kind") == "window", "room_id", "id")
    openings = doors.union(windows).withColumn("ord", F.row_number().over(line) - 1)
    return {"walls": walls, "openings": openings.select("scene_id", "wall_id", "ord", "kind", F.col("position_on_wall").alias("position"), "width", "height", "sill")}


def read_batch(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The scenes of a list of work, in line: (nth, name, image); the first ``limit`` of them."""
    rows = spark.read.schema("name string, image string").json(path, multiLine=True).withColumn("nth", F.monotonically_increasing_id())
    line = rows.withColumn("nth", F.row_number().over(Window.orderBy("nth")) - 1)  # a list of work, not data
    return line if limit is None else line.filter(F.col("nth") < limit)


def scene_ids(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, scene_id): the known id that ends with the name, or the next numbers after the largest, by name.

    ``known`` has scene_id, four digits, an underscore and a name.
    """
    old = known.select("scene_id", F.substring("scene_id", 6, 1 << 20).alias("name"), F.substring("scene_id", 1, 4).cast("int").alias("number"))
    first = old.groupBy("name").agg(F.min("scene_id").alias("scene_id"))
    top = old.agg(F.coalesce(F.max("number"), F.lit(-1)).alias("top"))
    found = names.select("name").distinct().join(first, "name", "left")
    new = found.filter("scene_id is null").withColumn("nth", F.row_number().over(Window.orderBy("name"))).join(F.broadcast(top))  # one row
    made = new.select("name", F.concat(F.lpad((F.col("top") + F.col("nth")).cast("string"), 4, "0"), F.lit("_"), "name").alias("scene_id"))
    return found.filter("scene_id is not null").select("name", "scene_id").union(made)


def image_keys(spark: SparkSession, path: str) -> DataFrame:
    """(path, key): the first sixteen hexadecimal digits of the SHA-256 of each image's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("key"))


def read_mask_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of equal ids in the rows of .npy instance masks; 0 and less is background."""

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from io import BytesIO

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                mask = np.load(BytesIO(content), allow_pickle=False).astype(np.int64)
                edge = np.ones(mask.shape, bool)
                edge[:, 1:] = mask[:, 1:] != mask[:, :-1]
                y, x = np.nonzero(edge)
                end = np.append(x[1:], 0)
                end = np.where(np.append(y[1:], -1) == y, end, mask.shape[1]) - 1
                out = pd.DataFrame({"cam": name.rsplit("/", 1)[-1].removesuffix(".npy").removesuffix("_seg"), "h": mask.shape[0], "w": mask.shape[1], "y": y, "x0": x, "x1": end, "iid": mask[y, x]})
                yield out[out["iid"] > 0]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(runs, "cam string, h int, w int, y bigint, x0 bigint, x1 bigint, iid bigint")


UPWARD = 0.9  # the least vertical part of a normal that points up


def read_upward_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of pixels whose normal points up, of .npy images of normals: (cam, y, x0, x1)."""

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from io import BytesIO

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                up = np.load(BytesIO(content), allow_pickle=False)[:, :, 2] > UPWARD
                edge = np.diff(np.pad(up, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                (y, x0), (_, x1) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                yield pd.DataFrame({"cam": name.rsplit("/", 1)[-1].removesuffix(".npy"), "y": y, "x0": x0, "x1": x1 - 1})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(runs, "cam string, y bigint, x0 bigint, x1 bigint")


def read_aux(spark: SparkSession, folder: str, scene_id: str) -> dict[str, DataFrame]:
    """mask_runs, upward_runs and instance_map of a scene's folder, of the cameras that have mask, normals and names.

    Files are instance_seg/{cam}.npy, instance_seg/{cam}_info.json (idToObjectId) and normals/{cam}.npy.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]+?)(_info)?\.(npy|json)$", 1)
    cams = lambda kind, end: spark.read.format("binaryFile").option("pathGlobFilter", f"*{end}").load(f"{folder}/{kind}").select(name("path").alias("cam"))
    both = cams("instance_seg", ".npy").intersect(cams("normals", ".npy")).intersect(cams("instance_seg", "_info.json"))
    masks, normals = read_mask_runs(spark, f"{folder}/instance_seg/*.npy"), read_upward_runs(spark, f"{folder}/normals/*.npy")
    info = spark.read.option("wholetext", True).text(f"{folder}/instance_seg/*_info.json").select(name(F.input_file_name()).alias("cam"), F.from_json("value", "idToObjectId map<string,string>").alias("i"))
    ids = info.select("cam", F.explode("i.idToObjectId").alias("iid", "object_id")).join(both, "cam").select(F.col("iid").cast("long").alias("iid"), "object_id").distinct()
    at = lambda df: df.join(both, "cam").withColumn("scene_id", F.lit(scene_id))
    return {"mask_runs": at(masks), "upward_runs": at(normals), "instance_map": ids.withColumn("scene_id", F.lit(scene_id))}


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Points of binary little-endian PLY files with colour, opacity, scales and unit quaternions decoded."""

    def unit(q: list[np.ndarray]) -> list[np.ndarray]:
        size = np.sqrt(sum(x * x for x in q))
        return [x / np.where(size > 0, size, 1) for x in q]

    def vertices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {"float": "<f4", "float32": "<f4", "double": "<f8", "uchar": "u1", "uint8": "u1", "int": "<i4", "int32": "<i4"}
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                head, _, body = content.partition(b"end_header\n")
                lines = [x.split() for x in head.decode("ascii").splitlines()]
                n = next(int(x[2]) for x in lines if x[:2] == ["element", "vertex"])
                rows = np.frombuffer(body, np.dtype([(x[2], kinds[x[1]]) for x in lines if x[0] == "property" and x[1] != "list"]), n)
                get = lambda k, rows=rows: rows[k].astype(float) if k in rows.dtype.names else np.full(len(rows), np.nan)
                yield pd.DataFrame({"source": name, "gid": np.arange(n), "x": get("x"), "y": get("y"), "z": get("z"), "red": 0.5 + 0.2820948 * get("f_dc_0"), "green": 0.5 + 0.2820948 * get("f_dc_1"), "blue": 0.5 + 0.2820948 * get("f_dc_2"), "opacity": 1 / (1 + np.exp(-get("opacity"))), **{f"scale_{i}": np.exp(get(f"scale_{i}")) for i in range(3)}, **{k: v for k, v in zip(("qw", "qx", "qy", "qz"), unit([get(f"rot_{i}") for i in range(4)]))}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(vertices, "source string, gid bigint, x double, y double, z double, red double, green double, blue double, opacity double, scale_0 double, scale_1 double, scale_2 double, qw double, qx double, qy double, qz double")


def write_questions(questions: DataFrame, path: str) -> None:
    """Questions (of question_records, or with columns of their names) as JSON, a folder for each scene and type, numbered from 0 within it."""
    line = Window.partitionBy("scene_id", "qtype").orderBy("question", "answer", *(c for c in ("cam", "cam_b", "a", "b", "c", "detail") if c in questions.columns))
    questions.withColumn("q_idx", F.row_number().over(line) - 1).write.mode("overwrite").partitionBy("scene_id", "qtype").json(path)


def write_scenes(objects: DataFrame, cameras: DataFrame, rooms: DataFrame, path: str) -> None:
    """Scenes as JSON that read_scenes reads: one line each, objects and cameras in line."""
    one = lambda df, *columns: df.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*columns).alias("v")))), lambda x: x.v).alias("list"))
    o = one(objects, "id", "type", "x", "y", "z", "rotation_z", "width", "length", "height").withColumnRenamed("list", "objects")
    c = one(cameras, "name", F.array("px", "py", "pz").alias("position"), F.array("lx", "ly", "lz").alias("look_at"), F.col("hfov").alias("horizontal_fov_deg"), "edge_direction", "step_direction", "step_from").withColumnRenamed("list", "cameras")
    r = rooms.select("scene_id", F.array("x_min", "y_min", "x_max", "y_max", "z_max").alias("room_bounds"))
    r.join(o, "scene_id", "left").join(c, "scene_id", "left").write.mode("overwrite").json(path)


def write_view_filter(verdicts: DataFrame, path: str) -> None:
    """Verdicts (of view_filter) as one JSON list for each scene, in the order of its cameras."""
    view = F.struct(F.col("cam").alias("camera_name"), "quality", "poor_lighting", "large_occlusion", "reason")
    line = F.transform(F.array_sort(F.collect_list(F.struct("ord", "cam", view.alias("v")))), lambda x: x.v)
    lists = verdicts.groupBy("scene_id").agg(F.to_json(line, {"ignoreNullFields": "false"}).alias("value"))
    lists.write.mode("overwrite").partitionBy("scene_id").text(path)


def read_view_filter(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, cam, quality, poor_lighting, large_occlusion, reason) of what write_view_filter writes, or of such lists in folders scene_id=..."""
    schema = "camera_name string, quality string, poor_lighting boolean, large_occlusion boolean, reason string, scene_id string"
    found = spark.read.schema(schema).json(path, multiLine=True)
    return found.select("scene_id", F.col("camera_name").alias("cam"), F.upper(F.coalesce("quality", F.lit("UNKNOWN"))).alias("quality"), "poor_lighting", "large_occlusion", "reason")
