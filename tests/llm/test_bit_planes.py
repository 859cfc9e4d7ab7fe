"""Files of id planes: exact round trips, the library's ids, documents over many blocks and tasks."""

import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracklake.llm import bit_planes

from .fixtures import documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("by", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_a_block_comes_back(by, n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 300, 49408, 1 << 32):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
        planes = bit_planes.planes_of(ids, by)
        assert all(any(p) for p in planes.values())
        assert (bit_planes.ids_of(planes, n, by) == ids).all()


@pytest.mark.parametrize("by", ["bit", "byte"])
def test_documents_are_found_from_any_block(by):
    rng = random.Random(3)
    docs = [(None if i == 0 else i, np.array([rng.randrange(50_000) for _ in range(rng.choice([0, 1, 3, 40, 500]))], "<u4")) for i in range(60)]
    out = io.BytesIO()
    writer = bit_planes.PlaneWriter(out, by, block=64)
    for key, ids in docs:
        writer.add(key, ids.tobytes())
    assert writer.close() == len(out.getvalue())
    f = bit_planes.PlaneFile(io.BytesIO(out.getvalue()), len(out.getvalue()))
    for step in (1, 2, 7, 10_000):
        got = [d for a in range(0, len(f.chunks), step) for d in f.documents(a, min(a + step, len(f.chunks)))]
        assert [(k, raw) for k, _, raw in got] == [(k, ids.tobytes()) for k, ids in docs]
        assert [start for _, start, _ in got] == [sum(len(ids) for _, ids in docs[:i]) for i in range(len(docs))]
    broken = bytearray(out.getvalue())
    with pytest.raises(ValueError, match="cut short"):
        bit_planes.PlaneFile(io.BytesIO(broken[:-1]), len(broken) - 1)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list(" \t\n\x1c\x85\xa0aA1'sSIİßÉé_|<>.,-")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_are_the_librarys(text):
    encoder, library = ENCODERS
    for t in (text, text.upper(), f"{text}<|endoftext|>'ll {text}"):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


ENCODERS = bit_planes.IdEncoder(PATH), Tokenizer.from_file(PATH)


@pytest.mark.parametrize("block, share", [(100, 150), (1 << 16, 16 << 20)])
def test_files_hold_all_ids_in_order(spark, tmp_path, block, share):
    docs = documents(spark)
    out = str(tmp_path / "ids")
    bit_planes.write_ids(docs, out, PATH, block=block)
    table = bit_planes.read_ids(spark, out, share)
    got = sorted(table.collect(), key=lambda r: r.start)
    rows = docs.collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda k: (k is not None, k or 0))
    library = Tokenizer.from_file(PATH)
    want = sorted(((r.doc_id, library_ids(library, r.text)) for r in rows), key=str)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=str) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    files = json.loads((tmp_path / "ids" / bit_planes.MANIFEST).read_text())["files"]
    assert sum(f["n_ids"] for f in files) == at and (share > 1000 or table.rdd.getNumPartitions() > len(files))
    report = bit_planes.id_files(docs, PATH, block=block).collect()
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in report) == [(r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got]


def test_one_id_on_many_rows_and_an_empty_table(spark):
    docs = documents(spark, [None, "a"]).limit(1)
    many = docs.selectExpr("cast(null as long) doc_id", "'same text' text").crossJoin(spark.range(500)).repartition(4)
    report = bit_planes.id_files(many, PATH).collect()
    assert len(report) == 500 and sorted(r.start for r in report) == [report[0].n_tokens * i for i in range(500)]
    assert bit_planes.id_files(docs.filter("false"), PATH).collect() == []
