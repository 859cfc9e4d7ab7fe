"""COCO annotations: read, filter, convert, write."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.boxes import area
from ..functions.ordering import with_row_number
from ..functions.storage import written
from .documents import json_text, write_document
from .json_elements import STRETCH, elements

SCHEMA = (
    "images array<struct<id:int,width:int,height:int,file_name:string>>, "
    "annotations array<struct<id:int,image_id:int,category_id:int,bbox:array<double>,area:double,iscrowd:int>>, "
    "categories array<struct<id:int,name:string,supercategory:string>>"
)


def read(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of files in order, with dataset_idx. Bad JSON raises."""
    if not paths:
        raise ValueError("no annotation files")
    whole = None
    for i, path in enumerate(paths):
        one = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("dataset_idx", F.lit(i))
        whole = one if whole is None else whole.unionByName(one)
    part = lambda c: whole.select("dataset_idx", F.explode(c).alias("x")).select("dataset_idx", "x.*")
    return part("images"), part("annotations"), part("categories")


def read_large(spark: SparkSession, paths: list[str], stretch: int = STRETCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As read(), for files of any size: each is read by many tasks, element by element, and once for all three tables."""
    if not paths:
        raise ValueError("no annotation files")
    found = [elements(spark, p, stretch).withColumn("dataset_idx", F.lit(i)) for i, p in enumerate(paths)]
    whole = written(functools.reduce(DataFrame.unionByName, found).select("dataset_idx", "section", "text"), "elements")
    whole = whole.withColumn("dataset_idx", F.coalesce("dataset_idx", F.lit(0)))  # never null, as in read()
    kinds = {f.name: f.dataType.elementType for f in T.StructType.fromDDL(SCHEMA)}
    part = lambda c: whole.filter(F.col("section") == c).select("dataset_idx", F.from_json("text", kinds[c], {"mode": "FAILFAST"}).alias("x")).select("dataset_idx", "x.*")
    return part("images"), part("annotations"), part("categories")


def annotation_files(dirs: list[str], files: list[str] | None = None, default: str = "VIA_JSON_combined_coco_gen.json") -> list[str]:
    """The annotation file of each dataset: the default one, a bare name within its annotations folder, or a path as given."""
    files = [default] * len(dirs) if not files else files
    if len(files) != len(dirs):
        raise ValueError(f"{len(dirs)} datasets but {len(files)} annotation files")
    return [f if "/" in f else f"{d.rstrip('/')}/annotations/{f}" for d, f in zip(dirs, files, strict=True)]


def image_dirs(dirs: list[str]) -> list[str]:
    return [f"{d.rstrip('/')}/frames" for d in dirs]


def exclude(images: DataFrame, annotations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images whose file_name isn't among the names(file_name), and their annotations."""
    kept = images.join(names, "file_name", "left_anti")
    gone = images.join(names, "file_name", "left_semi").select("dataset_idx", F.col("id").alias("image_id"))
    return kept, annotations.join(gone, ["dataset_idx", "image_id"], "left_anti")


def centers(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations as centre and size, with their image's name."""
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    named = annotations.join(images.select("dataset_idx", F.col("id").alias("image_id"), "file_name"), ["dataset_idx", "image_id"])
    return named.select("dataset_idx", "image_id", "file_name", (x + w / 2).alias("x"), (y + h / 2).alias("y"), w.alias("w"), h.alias("h"))


def of_boxes(boxes: DataFrame, category: str = "animal") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of boxes(image_idx, det_idx, x1..y2, and file_name or none): ids from 1, names by number where there are none."""
    name = F.col("file_name") if "file_name" in boxes.columns else F.format_string("frame_%04d.png", F.col("image_idx").cast("int"))
    named = boxes.withColumn("file_name", name)
    image = named.groupBy("image_idx").agg(F.min("file_name").alias("file_name"))
    image = image.select((F.col("image_idx") + 1).alias("id"), F.lit(0).alias("width"), F.lit(0).alias("height"), "file_name")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = with_row_number(boxes, ["image_idx", "det_idx"], "id")
    annotation = rows.select("id", (F.col("image_idx") + 1).alias("image_id"), F.lit(1).alias("category_id"), F.array("x1", "y1", w, h).alias("bbox"), area("x1", "y1", "x2", "y2").alias("area"), F.lit(0).alias("iscrowd"))
    return image, annotation, boxes.sparkSession.createDataFrame([(1, category, "animal")], "id int, name string, supercategory string")


def document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """The three tables as one row, for small ones; write() takes any size."""
    listed = lambda df, cols, name: df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    i = listed(images, ["id", "width", "height", "file_name"], "images")
    a = listed(annotations, ["id", "image_id", "category_id", "bbox", "area", "iscrowd"], "annotations")
    c = listed(categories, ["id", "name", "supercategory"], "categories")
    return i.join(F.broadcast(a)).join(F.broadcast(c))


def write(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, mode: str = "error") -> None:
    """Writes the three tables as one COCO document, elements in order of their ids; no row holds more than one."""
    element = lambda df, cols: df.select("id", json_text(F.struct(*cols)).alias("json"))
    pieces = ['{"images":[', element(images, ["id", "width", "height", "file_name"]), '],"annotations":[', element(annotations, ["id", "image_id", "category_id", "bbox", "area", "iscrowd"])]
    write_document(images.sparkSession, path, [*pieces, '],"categories":[', element(categories, ["id", "name", "supercategory"]), "]}"], mode)


def split(images: DataFrame, seed: int = 42, train: float = 0.8, test_of_rest: float = 0.5, key: str = "id") -> DataFrame:
    """Adds split: train, test or val, with exact shares of the images in a seeded order; test and val share what train leaves."""
    hashed = images.withColumn("__h", F.xxhash64(F.lit(seed), key))
    ranked = with_row_number(hashed, ["__h", key], "__n", 0).drop("__h")
    n = ranked.count()
    cut = int(n * train)
    stop = cut + int((n - cut) * test_of_rest)
    return ranked.withColumn("split", F.when(F.col("__n") < cut, "train").when(F.col("__n") < stop, "test").otherwise("val")).drop("__n")


def batches(images: DataFrame, size: int, seed: int | None = None, key: str = "id") -> DataFrame:
    """Adds batch: consecutive images, or images in a seeded order, that go through a model together."""
    order = [key] if seed is None else [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    return with_row_number(images, order, "__n", 0).withColumn("batch", F.expr(f"__n div {size}")).drop("__n")


def limited(batched: DataFrame, limit: int | float) -> DataFrame:
    """The first batches: so many, or (a fraction) that share of all of them, cut to a whole number."""
    if isinstance(limit, int):
        return batched.filter(F.col("batch") < limit)
    share = batched.agg((F.floor((F.max("batch") + 1) * F.lit(float(limit)))).alias("__limit"))  # one row
    return batched.join(F.broadcast(share)).filter(F.col("batch") < F.col("__limit")).drop("__limit")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
