"""VIA annotations: track tables (CSV with JSON cells) and projects (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.boxes import xywh_to_xyxy, xyxy_to_center
from ..functions.ordering import with_row_number
from ..functions.storage import written
from .documents import json_text, write_document
from .json_elements import STRETCH, elements

CSV_SCHEMA = "filename string, file_size int, file_attributes string, region_count int, region_id int, region_shape_attributes string, region_attributes string"
SHAPE = "struct<name:string,x:double,y:double,width:double,height:double>"
ATTRIBUTES = "struct<track:string,confidence:string>"
REGION = "struct<shape_attributes:struct<name:string,x:double,y:double,width:double,height:double>,region_attributes:map<string,string>>"
PROJECT = (
    "_via_settings struct<core:struct<default_filepath:string>,project:struct<name:string>>, _via_attributes string, _via_data_format_version string, "
    f"_via_image_id_list array<string>, _via_img_metadata map<string,struct<filename:string,size:long,regions:array<{REGION}>>>"
)


def _struct(columns: str) -> str:
    return "struct<" + ",".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in columns.split(", ")) + ">"


def track_id(text: Column | str) -> Column:
    """Ids are written as numbers with a fraction at times: "2.0" is 2."""
    c = F.col(text) if isinstance(text, str) else text
    return c.try_cast("double").cast("int")


def parse_rows(rows: DataFrame) -> DataFrame:
    """frame, gt_id, x, y, width, height, confidence of rows with VIA's columns."""
    shape = F.from_json("region_shape_attributes", SHAPE)
    attributes = F.from_json("region_attributes", ATTRIBUTES)
    parsed = rows.withColumn("__s", shape).withColumn("__a", attributes)
    return parsed.select(
        *(c for c in rows.columns if c not in ("region_shape_attributes", "region_attributes")),
        names.frame_number("filename").alias("frame"),
        track_id(F.col("__a.track")).alias("gt_id"),
        F.col("__s.x").alias("x"),
        F.col("__s.y").alias("y"),
        F.col("__s.width").alias("width"),
        F.col("__s.height").alias("height"),
        F.col("__a.confidence").try_cast("double").alias("confidence"),
    )


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CSV_SCHEMA).option("header", True).option("quote", '"').option("escape", '"').option("pathGlobFilter", "*.csv").csv(path)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of track files: video, clip_file, frame, gt_id, gt_idx (order in a frame), x1..y2, confidence."""
    rows = read_rows(spark, path).withColumn("file", F.col("_metadata.file_path")).withColumn("row", F.monotonically_increasing_id())
    boxes = parse_rows(rows)
    x1, y1, x2, y2 = xywh_to_xyxy("x", "y", "width", "height")
    order = F.row_number().over(Window.partitionBy("file", "frame").orderBy("row")) - 1
    return boxes.select(
        names.video_name("file").alias("video"), names.clip_file("file").alias("clip_file"), "frame", "gt_id", order.alias("gt_idx"),
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), "confidence",
    )


def observations(boxes: DataFrame) -> DataFrame:
    """Boxes as observations: frame t, individual, centre, size and confidence. NaN becomes null."""
    x, y, w, h = xyxy_to_center("x1", "y1", "x2", "y2")
    clean = lambda c: F.when(~F.isnan(c), c)
    kept = [c for c in boxes.columns if c not in ("frame", "gt_id", "gt_idx", "x1", "y1", "x2", "y2", "confidence")]
    return boxes.select(*kept, F.col("frame").alias("t"), F.col("gt_id").alias("individual"), clean(x).alias("x"), clean(y).alias("y"), clean(w).alias("w"), clean(h).alias("h"), clean(F.col("confidence")).alias("confidence"))


def rows_of_tracks(tracks: DataFrame, file_size: int = 8888, clip: int = 123) -> DataFrame:
    """VIA rows of tracks(frame, track_id, x1..y2, score): position as numbers, size cut to whole pixels."""
    w, h = (F.col("x2") - F.col("x1")).cast("int").cast("string"), (F.col("y2") - F.col("y1")).cast("int").cast("string")
    shape = F.concat(F.lit('{"name":"rect","x":'), F.col("x1").cast("string"), F.lit(',"y":'), F.col("y1").cast("string"), F.lit(',"width":'), w, F.lit(',"height":'), h, F.lit("}"))
    attributes = F.concat(F.lit('{"track":"'), F.col("track_id").cast("int").cast("string"), F.lit('", "confidence":"'), F.col("score").cast("string"), F.lit('"}'))
    return tracks.select(
        F.format_string("frame_%08d.png", F.col("frame").cast("int")).alias("filename"), F.lit(file_size).alias("file_size"), F.lit(f'{{"clip":{clip}}}').alias("file_attributes"),
        F.lit(1).alias("region_count"), F.lit(0).alias("region_id"), shape.alias("region_shape_attributes"), attributes.alias("region_attributes"),
    )


def write_tracks(tracks: DataFrame, path: str, order: tuple[str, ...] = ("frame", "emit_idx"), **options) -> None:
    """Writes VIA's CSV, rows in order of frames over the part files."""
    rows_of_tracks(tracks.orderBy(*order)).write.option("header", True).option("quote", '"').option("escape", '"').csv(path, **options)


def read_projects(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """VIA projects, one a file, with the file's path; files whose path matches the pattern, and other JSON, are left out. Bad JSON raises."""
    df = spark.read.schema(PROJECT).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
    df = df.withColumn("file", F.col("_metadata.file_path")).filter(F.col("_via_img_metadata").isNotNull())
    return without(df, exclude)


def without(df: DataFrame, pattern: str | None, column: str = "file") -> DataFrame:
    """Rows whose column doesn't match the pattern anywhere; all rows for none."""
    return df.filter(~F.col(column).rlike(pattern)) if pattern else df


def images(projects: DataFrame) -> DataFrame:
    """file, key, img_pos, filename, regions of each image."""
    return projects.select("file", F.posexplode(F.map_entries("_via_img_metadata")).alias("img_pos", "e")).select("file", "img_pos", F.col("e.key").alias("key"), F.col("e.value.filename").alias("filename"), F.col("e.value.regions").alias("regions"))


def read_images(spark: SparkSession, path: str, exclude: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """images() of project files of any size: each is read by many tasks, image by image. img_pos: the image's place in its file."""
    found = without(elements(spark, path, stretch).filter("section = '_via_img_metadata'"), exclude)
    kind = f"map<string,struct<filename:string,regions:array<{REGION}>>>"
    entry = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), kind, {"mode": "FAILFAST"})
    return found.select("file", F.col("pos").alias("img_pos"), F.explode(entry).alias("key", "e")).select("file", "img_pos", "key", "e.filename", "e.regions")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with a key, those of the last in order."""
    latest = F.max(F.struct(*order)).over(Window.partitionBy(*key))
    return df.withColumn("__last", latest).filter(F.col("__last") == F.struct(*order)).drop("__last")


def combine(projects: DataFrame) -> DataFrame:
    """Images of all projects, the last file's where several have one, at the place of its first file."""
    return combine_images(images(projects))


def combine_images(every: DataFrame) -> DataFrame:
    """combine() of images() or read_images()."""
    w = Window.partitionBy("key")
    placed = every.withColumn("first", F.min(F.struct("file", "img_pos")).over(w)).withColumn("last", F.max("file").over(w))
    return placed.filter("file = last").select("key", "filename", "regions", "first")


def _settings(projects: DataFrame, default_dir: str | None, project_name: str | None) -> DataFrame:
    if default_dir is not None and not default_dir.startswith("/"):
        raise ValueError(f"the default folder must be an absolute path: {default_dir}")
    first = projects.orderBy("file").limit(1).select("_via_settings", "_via_attributes", "_via_data_format_version")
    settings = F.struct(
        F.struct((F.lit(default_dir.rstrip("/") + "/") if default_dir else F.col("_via_settings.core.default_filepath")).alias("default_filepath")).alias("core"),
        F.struct((F.lit(project_name) if project_name else F.col("_via_settings.project.name")).alias("name")).alias("project"),
    )
    return first.withColumn("_via_settings", settings)


def write_project(projects: DataFrame, path: str, default_dir: str | None = None, project_name: str | None = None, mode: str = "error") -> None:
    """Writes combined_project() as one document of any size; no row holds more than an image."""
    kept = ["_via_settings", "_via_attributes", "_via_data_format_version"]
    rest = _settings(projects, default_dir, project_name).select(*(F.when(F.col(c).isNotNull(), json_text(F.col(c))).alias(c) for c in kept)).first()  # one row
    if rest is None:
        return write_document(projects.sparkSession, path, [], mode)
    placed = combine(projects)
    value = F.struct(F.col("filename"), F.lit(None).cast("long").alias("size"), F.col("regions"))
    pictures = placed.select("first", F.concat(json_text(F.col("key")), F.lit(":"), json_text(value)).alias("json"))
    ids = projects.select("file", F.posexplode("_via_image_id_list").alias("at", "id")).select("file", "at", json_text(F.col("id")).alias("json"))
    own = {c: [f'"{c}":{rest[c]}'] for c in kept if rest[c] is not None}
    own |= {"_via_img_metadata": ['"_via_img_metadata":{', pictures, "}"], "_via_image_id_list": ['"_via_image_id_list":[', ids, "]"]}
    pieces: list[str | DataFrame] = ["{"]
    for i, c in enumerate(c for c in (c.split()[0] for c in PROJECT.split(", ")) if c in own):
        pieces += [","] * (i > 0) + own[c]
    write_document(projects.sparkSession, path, [*pieces, "}"], mode)


def combined_project(projects: DataFrame, default_dir: str | None = None, project_name: str | None = None) -> DataFrame:
    """One project of all as one row, for small ones (write_project() takes any size): settings of the first file, images with the last file's regions, id lists one after another with repeats."""
    first = _settings(projects, default_dir, project_name)
    # maps don't order, so images are sorted by place and number alone and looked up again
    placed = combine(projects).withColumn("value", F.to_json(F.struct("filename", "regions")))
    listed = placed.agg(F.array_sort(F.collect_list(F.struct("first", "key", "value"))).alias("l"))
    value = _struct("filename string, size long, regions array<" + REGION + ">")
    pictures = listed.select(F.map_from_entries(F.transform("l", lambda x: F.struct(x["key"].alias("key"), F.from_json(x["value"], value).alias("value")))).alias("_via_img_metadata"))
    ids = projects.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file", "_via_image_id_list"))), lambda x: x["_via_image_id_list"])).alias("_via_image_id_list"))
    return first.join(F.broadcast(ids)).join(F.broadcast(pictures)).select(*(c.split()[0] for c in PROJECT.split(", ")))


def coco_rows(pictures: DataFrame, order: list[str], category: str = "animal") -> tuple[DataFrame, DataFrame, DataFrame]:
    """COCO images, annotations and categories of images(filename, regions): ids from 1 in order, size 0 by 0, area of the box.

    order tells images apart. The images are written to the shared folder once. Only order, the name and the number of regions are sorted; a box's id is the
    number of regions of the images before, and its place in its own.
    """
    pictures = written(pictures, "pictures")
    keys = pictures.select(*order, *(["filename"] if "filename" not in order else []), F.size("regions").alias("__n"))
    numbered = with_row_number(keys, order, "id", weight="__n")
    image = numbered.select("id", F.lit(0).alias("width"), F.lit(0).alias("height"), F.col("filename").alias("file_name"))
    with_ids = pictures.select(*order, "regions").join(numbered.select(*order, "id", "__n_before"), order)
    boxes = with_ids.select(F.col("id").alias("image_id"), "__n_before", F.posexplode("regions").alias("pos", "r"))
    boxes = boxes.select((F.col("__n_before") + F.col("pos") + 1).alias("id"), "image_id", F.col("r.shape_attributes").alias("s"))
    annotation = boxes.select("id", "image_id", F.lit(1).alias("category_id"), F.array("s.x", "s.y", "s.width", "s.height").alias("bbox"), (F.col("s.width") * F.col("s.height")).alias("area"), F.lit(0).alias("iscrowd"))
    spark = pictures.sparkSession
    return image, annotation, spark.createDataFrame([(1, category, "animal")], "id int, name string, supercategory string")


def write_json(df: DataFrame, path: str, **options) -> None:
    df.coalesce(1).write.json(path, **options)
