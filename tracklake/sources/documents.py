"""One JSON document of any size: its elements are sorted and formatted in parallel, and joined as bytes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_dir

#: Bytes that are copied at a time.
BUFFER = 1 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else os.path.abspath(path))


def json_text(value: Column) -> Column:
    """A value of any type as JSON."""
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _parts(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and f.base_name.startswith("part-") and f.size]
    return sorted(found, key=lambda f: f.base_name)


def write_document(spark: SparkSession, path: str, pieces: list[str | DataFrame], mode: str = "error") -> None:
    """Writes the folder path with one file, the pieces one after another and a line end.

    A piece is text, or a table with a column json, an element each, and others that order it; its elements come out with
    commas between them. Elements are sorted over ranges and formatted to files of the shared folder by many
    tasks; one more task copies these files, a buffer at a time, under another name, which is changed at the end.
    mode: error, overwrite or ignore, if the folder has files already.
    """
    if mode not in ("error", "errorifexists", "overwrite", "ignore"):
        raise ValueError(f"a document can't be written with mode {mode}")
    store, root = store_of(path)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise FileExistsError(path)
        store.delete_dir_contents(root)
    stage = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    plan: list[str | int] = []
    for i, piece in enumerate(pieces):
        if not isinstance(piece, str):
            piece.orderBy(*(c for c in piece.columns if c != "json")).select("json").write.option("lineSep", ",").text(f"{stage}/{i}")
        plan.append(piece if isinstance(piece, str) else i)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            (source, staged), (target, folder) = store_of(stage), store_of(path)
            target.create_dir(folder, recursive=True)
            temporary = f"{folder}/_document-{uuid.uuid4().hex}"
            with target.open_output_stream(temporary) as out:
                for piece in plan:
                    if isinstance(piece, str):
                        out.write(piece.encode())
                        continue
                    parts = _parts(source, f"{staged}/{piece}")
                    left = sum(f.size for f in parts) - 1  # all but the last comma
                    for f in parts:
                        with source.open_input_stream(f.path) as part:
                            while left > 0 and (block := part.read(min(BUFFER, left))):
                                out.write(block)
                                left -= len(block)
                out.write(b"\n")
            target.move(temporary, f"{folder}/part-00000.json")
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    spark.range(1, numPartitions=1).mapInArrow(join, "done long").collect()
    source, staged = store_of(stage)
    if any(not isinstance(piece, str) for piece in plan):
        source.delete_dir(staged)
