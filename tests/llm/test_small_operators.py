"""Quality, packing, counts, fingerprints, SentencePiece, language ID, sharding: each against a plain form of itself."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklake.llm import fingerprints, language_id, packing, quality, sentencepiece_codec, sharding, token_counts

from .fixtures import documents

EMPTY = pytest.mark.parametrize


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


# quality


def repeats_brute(w, least):
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    gone = set()
    for i, k in enumerate(longest):
        if k >= least:
            gone.update(range(i, i + k))
    return len(gone), max([k for k in longest if k >= quality.WINDOW], default=0)


def measures_brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    gone = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(gone)


def test_quality_equals_brute_force(spark):
    docs = documents(spark)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect())
    want = Counter()
    for d, t in rows_of(docs):
        m = measures_brute(t)
        want[(d, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=5))
def test_repeats_equal_brute_force(docs):
    flat = np.array([c for d in docs for c in d], np.int64)
    bounds = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
    longest = quality.repeats(flat, bounds)
    for least in (5, 7):
        assert quality.covered(longest, bounds, least).tolist() == [repeats_brute(d, least)[0] for d in docs]


def test_keep_good_filters_in_place(spark):
    docs = documents(spark)
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.quality(docs).filter("kept").collect())
    assert quality.keep_good(documents(spark, [])).collect() == []


# packing


def test_packing_is_whole_and_exact(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark).dropDuplicates(["doc_id"]).filter("doc_id is not null")
    rows = packing.pack(docs, path, public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=256).collect()
    library = Tokenizer.from_file(path)
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows_of(docs)}
    seen, sequences = Counter(), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == Counter((d, i) for d, x in ids.items() for i in range(len(x)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(documents(spark, []), path).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_assignment_covers_each_token_once(lengths):
    pieces = packing.assign(lengths, 32, 1.0, 0.1)
    cover = Counter((d, i) for d, a, n, _, _ in pieces for i in range(a, a + n))
    assert cover == Counter((d, i) for d, n in enumerate(lengths) for i in range(n))
    full = defaultdict(int)
    for _, _, n, s, _ in pieces:
        full[s] += n
    assert all(x == 32 or x & (x - 1) == 0 for x in full.values())


# token counts


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = documents(spark)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, path).collect())
    want = Counter()
    for d, t in rows_of(docs):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(d, len((t or "").encode()), n, n > 2048)] += 1
    assert got == want
    assert token_counts.token_counts(documents(spark, []), path).collect() == []


COUNTER = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("aabnhe'sIıİΣσς<|startoftext|> 12é́ ", max_size=60))
def test_token_counts_of_any_text(text):
    assert COUNTER.counts([text]) == [len(COUNTER.library.encode(text, add_special_tokens=False).ids)]


# fingerprints


def test_edited_texts_and_neighbours(spark):
    docs = documents(spark)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edited_fingerprints(docs).collect())
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want[(d, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert got == want


def test_likeness_orders_and_bounds(spark):
    docs = documents(spark)
    rows = fingerprints.edited_fingerprints(docs).collect()
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    by_text = defaultdict(set)
    for r, (_, t) in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(rows_of(docs), key=lambda r: str(r[0])), strict=True):
        by_text[t].add(r.fingerprint) if r.doc_id not in (12, 13, None) else None
    assert all(len(x) == 1 for x in by_text.values() if x)
    one = fingerprints.edited_fingerprints(documents(spark, ["alone in the table"])).collect()
    assert one[0].near_next == 1.0
    assert fingerprints.edited_fingerprints(documents(spark, [])).collect() == []


# sentencepiece


def library_unigram(codec):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        p.score = float(codec.score[i])
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


CODEC = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_round_trip_of_any_text(text):
    text = text.replace("▁", "")
    ids = np.frombuffer(sentencepiece_codec.Encoder(CODEC).encode([text])[0], "<u4")
    assert CODEC.decode(ids.tolist()) == text


def test_encoding_scores_as_well_as_the_library():
    library = library_unigram(CODEC)
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join("".join(rng.choice("etaoinshrdluéöñ") for _ in range(rng.randrange(1, 14))) for _ in range(3))
        ids = np.frombuffer(sentencepiece_codec.Encoder(CODEC).encode([text])[0], "<u4").tolist()
        theirs = library.encode(text)
        assert abs(sum(CODEC.score[ids]) - sum(CODEC.score[theirs])) < 1e-3
        assert library.decode(ids) == text


def test_codec_queries(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((d, (t or "").replace("▁", " ")) for d, t in rows_of(docs))
    assert sentencepiece_codec.round_trips(docs, path).filter("not round_trip").count() == sum("▁" in (t or "") for _, t in rows_of(docs))
    assert sentencepiece_codec.encode(documents(spark, []), path).collect() == []


# language


def test_forward_backward_equals_enumeration():
    rng = np.random.RandomState(1)
    emit, trans = rng.randn(7, 3), rng.randn(3, 3)
    bounds = np.array([0, 3, 3, 7])
    marginal, pairs, total = language_id.forward_backward(emit, bounds, trans)
    want, want_pairs, norm = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for a, b in ((0, 3), (3, 7)):
        weights = {}
        for path in np.ndindex(*[3] * (b - a)):
            weights[path] = np.exp(sum(emit[a + i, y] for i, y in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:], strict=False)))
        z = sum(weights.values())
        norm += np.log(z)
        for path, v in weights.items():
            for i, y in enumerate(path):
                want[a + i, y] += v / z
            for x, y in zip(path, path[1:], strict=False):
                want_pairs[x, y] += v / z
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(total, norm)


LANGS = {"aa": ["bako", "tilo", "mena", "soru", "kapi"], "bb": ["xzer", "wqth", "ghyx", "vrzt", "plqx"]}


def sentence(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(["", "n", "s"]) for _ in range(n))


def test_language_of_held_out_and_mixed_texts(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, g, 40), g, "s", 0, *["c"] * 9) for i in range(160) for g in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa", "s", 0, *["c"] * 9), (901, "12 34 !", "bb", "s", 0, *["c"] * 9), (902, sentence(rng, "aa", 60) + " " + sentence(rng, "bb", 20), None, "s", 0, *["c"] * 9)]
    docs = spark.createDataFrame(rows, documents(spark, []).schema)
    out = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert all(out[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert all(out[r[0]].lang_pred == r[2] for r in rows[:160])
    assert (out[900].lang_pred, out[900].score, out[901].lang_pred) == ("und", 0.0, "und")
    assert out[902].lang_pred == "aa" and 0.6 < out[902].score < 0.9 and out[902].n_switches == 1
    assert language_id.language_id(documents(spark, [])).collect() == []
    unlabelled = documents(spark, ["some text"]).drop("lang").selectExpr("*", "cast(null as string) lang")
    assert language_id.language_id(unlabelled).collect()[0].lang_pred == "und"


# sharding


def test_shards_follow_the_law_and_the_mixture(spark):
    docs = documents(spark)
    rows = sharding.shards(docs, 6, parts=16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows_of(docs))
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    big = spark.range(3000).selectExpr("id doc_id", "cast(id as string) text", "case when id % 3 = 0 then 'hot' else concat('s', id % 11) end source")
    placed = sharding.shards(big, 10).join(big, "doc_id").groupBy("source", "shard").count().collect()
    by = defaultdict(list)
    for r in placed:
        by[r.source].append(r["count"])
    # the cuts fall on whole rows of all twelve sources, so a share may be off by a few of them
    assert all(abs(c - sum(x) / 10) <= 3 and len(x) == 10 for x in by.values() for c in x)
    assert sharding.shards(documents(spark, [])).collect() == []
    assert [tuple(r) for r in sharding.shards(docs, 6).orderBy("shard", "slot").collect()] == [tuple(r) for r in sharding.shards(docs.repartition(3), 6).orderBy("shard", "slot").collect()]
