"""Documents of any size have the bytes of those written as one row."""

import json

import pytest
from pyspark.sql import functions as F

from tracklake.sources import coco, documents, via

from .test_sources_and_store import project


def content(path):
    files = [f for f in path.iterdir() if f.name.startswith("part-")]
    assert len(files) == 1 and not [f for f in path.iterdir() if f.name.startswith("_document")]
    return files[0].read_bytes()


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_coco_documents_are_equal(spark, tmp_path, n):
    images = spark.range(n).selectExpr("cast(id + 1 as int) id", "0 width", "0 height", "concat('ü \"', id, '\".png') file_name").repartition(3)
    boxes = spark.range(3 * n).selectExpr("cast(id + 1 as int) id", "cast(id div 3 + 1 as int) image_id", "1 category_id", "array(id / 7, 2.0, 3.0, 4.0) bbox", "if(id % 2 = 0, null, 12.0) area", "0 iscrowd").repartition(5)
    kinds = spark.createDataFrame([(1, "crab, \\ [x]", "animal")], "id int, name string, supercategory string")
    via.write_json(coco.document(images, boxes, kinds), str(tmp_path / "old"))
    coco.write(images, boxes, kinds, str(tmp_path / "new"))
    assert content(tmp_path / "new") == content(tmp_path / "old")
    with pytest.raises(FileExistsError):
        coco.write(images, boxes, kinds, str(tmp_path / "new"))
    coco.write(images.limit(0), boxes.limit(0), kinds, str(tmp_path / "new"), "overwrite")
    assert json.loads(content(tmp_path / "new"))["images"] == []


def test_project_documents_are_equal(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, pictures in (("b.json", {"x.png": 2, 'q"é.png': 1}), ("a.json", {"x.png": 1, "y.png": 0}), ("c.json", {"z.png": 3})):
        (tmp_path / "in" / name).write_text(project(pictures))
    projects = via.read_projects(spark, str(tmp_path / "in"))
    for i, args in enumerate([(), ("/new/place", "all")]):
        via.write_json(via.combined_project(projects, *args), str(tmp_path / f"old{i}"))
        via.write_project(projects, str(tmp_path / f"new{i}"), *args)
        assert content(tmp_path / f"new{i}") == content(tmp_path / f"old{i}")
    with pytest.raises(ValueError):
        via.write_project(projects, str(tmp_path / "other"), "relative")


def test_elements_are_sorted_over_many_files(spark, tmp_path):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("at")).repartition(8)
    rows = rows.select("at", documents.json_text(F.struct("at", F.repeat(F.lit(",]"), F.col("at").cast("int") % 9).alias("s"))).alias("json"))
    plans = []
    documents.write_document(spark, str(tmp_path / "d"), ["[", rows, "]"])
    found = json.loads(content(tmp_path / "d"))
    assert [r["at"] for r in found] == list(range(5000)) and found[8]["s"] == ",]" * 8
    plans.append(rows.orderBy("at")._jdf.queryExecution().toString())
    assert "collect_list" not in plans[0]
