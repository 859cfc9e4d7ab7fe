"""Elements of documents that are cut anywhere, against the standard parser."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyspark.sql import functions as F

from tracklake.sources import coco, json_elements, via

from .test_sources_and_store import project

ODD = ['"', "\\", '\\"', "{", "}", "[", "]", ",", ":", "é", "\U0001f980", " ", "\n", "x", '":{', "\\\\"]


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return "".join(rng.choice(ODD) for _ in range(rng.randrange(12)))
    if kind < 3:
        return rng.choice([None, True, 1, -2.5, "plain"])
    if kind == 3:
        return {"".join(rng.choice(ODD) for _ in range(3)) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("stretch", [5, 97, 100_000])
def test_elements_equal_the_parsers(spark, tmp_path, stretch):
    rng = random.Random(stretch)
    docs = {}
    for i in range(4):
        doc = {f'k"{i},[': [value(rng) for _ in range(rng.randrange(9))], "scalar": "a\\", "none": [], "o{": {f"é{j}": value(rng) for j in range(rng.randrange(6))}, "last": 'x"'}
        docs[f"d{i}.json"] = doc
        (tmp_path / f"d{i}.json").write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
    (tmp_path / "empty.json").write_text("")
    got = {}
    for r in json_elements.elements(spark, str(tmp_path), stretch).orderBy("file", "pos").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {}).setdefault(json.loads(f'"{r.section}"'), []).append(r.text)
    for name, doc in docs.items():
        for section, whole in doc.items():
            texts = got[name].get(section, [])
            if isinstance(whole, list):
                assert [json.loads(t) for t in texts] == whole
            elif isinstance(whole, dict):
                assert json.loads("{" + ",".join(texts) + "}") == whole
            else:
                assert not texts


def test_quotes_behind_backslashes():
    raw = b'a"b\\"c\\\\"d\\\\\\"e"'
    assert json_elements.open_quotes(np.frombuffer(raw, np.uint8), 0).tolist() == [1, 8, 15]
    for cut in range(1, len(raw)):
        n = len(raw[:cut]) - len(raw[:cut].rstrip(b"\\"))
        both = [*json_elements.open_quotes(np.frombuffer(raw[:cut], np.uint8), 0), *(cut + json_elements.open_quotes(np.frombuffer(raw[cut:], np.uint8), n))]
        assert both == [1, 8, 15], cut


@pytest.mark.parametrize("stretch", [50, 4 << 20])
def test_annotations_are_read_by_many_tasks(spark, tmp_path, stretch):
    images = [{"id": i, "width": 0, "height": 0, "file_name": f'f"{i}.png'} for i in range(50)]
    boxes = [{"id": i, "image_id": i % 50, "category_id": 1, "bbox": [i, 2.0, 3.0, 4.0], "area": 12.0, "iscrowd": 0} for i in range(120)]
    (tmp_path / "a.json").write_text(json.dumps({"images": images, "annotations": boxes, "categories": [{"id": 1, "name": "c", "supercategory": "animal"}]}))
    path = str(tmp_path / "a.json")
    for large, small in zip(coco.read_large(spark, [path, path], stretch), coco.read(spark, [path, path]), strict=True):
        assert sorted(map(str, large.collect())) == sorted(map(str, small.collect())) and large.schema == small.schema
    cut = json_elements.stretches(spark, path, stretch)
    assert cut.count() == -(-(tmp_path / "a.json").stat().st_size // stretch)
    (tmp_path / "bad.json").write_text('{"images": [{"id": 1}')
    with pytest.raises(ValueError, match="malformed"):
        coco.read_large(spark, [str(tmp_path / "bad.json")], stretch)
    (tmp_path / "bad.json").write_text('{"images": [{"id": nope}]}')
    with pytest.raises(Exception, match="(?i)malformed"):
        coco.read_large(spark, [str(tmp_path / "bad.json")], stretch)[0].collect()


def test_projects_image_by_image(spark, tmp_path):
    (tmp_path / "a.json").write_text(project({"x.png": 1, 'y"é.png': 2}, "first"))
    (tmp_path / "b.json").write_text(project({"z.png": 0, "x.png": 3}))
    (tmp_path / "c_coco.json").write_text('{"images": [], "annotations": []}')
    plain = via.combine(via.read_projects(spark, str(tmp_path))).select("key", "filename", "regions").collect()
    large = via.combine_images(via.read_images(spark, str(tmp_path), stretch=40)).select("key", "filename", "regions").collect()
    assert sorted(map(str, large)) == sorted(map(str, plain)) and len(large) == 3
    assert via.read_images(spark, str(tmp_path), "b.json", 40).count() == 2


def test_stretches_are_dealt_to_many_tasks_and_read_once(spark, tmp_path, monkeypatch):
    """Stretches are a few small rows, which Spark puts into one task if it is let; three tables come from one reading."""
    rows = [{"id": i, "image_id": i, "category_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0], "area": 12.0, "iscrowd": 0} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": i, "width": 1, "height": 2, "file_name": f'"{i}]'} for i in range(3000)], "annotations": rows, "categories": []}))
    cut = json_elements.elements(spark, str(tmp_path), 1 << 14)
    assert cut.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    made = []
    real = coco.elements
    monkeypatch.setattr(coco, "elements", lambda *a: made.append(real(*a)) or made[-1])
    images, annotations, categories = coco.read_large(spark, [str(tmp_path)], 1 << 14)
    assert (images.count(), annotations.count(), categories.count()) == (3000, 3000, 0)
    assert annotations.agg(F.sum("image_id")).first()[0] == sum(range(3000)) and len(made) == 1
    for table in (images, annotations):
        assert "MapInArrow" not in table._jdf.queryExecution().executedPlan().toString()
