"""Operators that SQL can't express against plain Python versions, row by row."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tracklake.llm import fingerprints, language_id, pii, quality, sharding

from . import plain_pii
from .fixtures import documents, texts, words
from .test_ngram_join import sets_of
from .test_pii import ROWS
from .test_small_operators import LANGS, measures_brute, repeats_brute, rows_of, sentence
from .test_suffix_dedup import covered

# op5: digests and likeness


def plain_digest(raw):
    counts = [0] * 128
    for i in range(len(raw)):
        for j, k in ((1, 2), (1, 3), (2, 3)):
            if i + k < len(raw):
                h = sum(b * f for b, f in zip((raw[i], raw[i + j], raw[i + k]), fingerprints.FACTORS, strict=True)) & 0xFFFFFFFF
                counts[((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 25] += 1
    cuts = [sorted(counts)[i] for i in (31, 63, 95)]
    quartiles = [sum(c > q for q in cuts) for c in counts]
    length = min(int(np.floor(4 * np.log2(len(raw) + 1.0))), 255)
    packed = bytes(quartiles[i] << 6 | quartiles[i + 1] << 4 | quartiles[i + 2] << 2 | quartiles[i + 3] for i in range(0, 128, 4))
    return quartiles, length, (bytes([length]) + packed).hex()


def plain_likeness(a, b):
    apart = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[0], b[0], strict=True)) + abs(a[1] - b[1])
    return 1 - min(apart, 240) / 240


def test_digests_and_likeness(spark):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(rows_of(docs))
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, following = (plain_digest(x.encode()) for x in (t, edited, after))
        r = got[d]
        assert (r.fingerprint, r.edited_fingerprint) == (own[2], changed[2])
        assert (r.near_edited, r.near_next) == pytest.approx((plain_likeness(own, changed), plain_likeness(own, following)))


# op9: rank, fraction, cut


@pytest.mark.parametrize("n_shards", [5, 24])
def test_shards_by_rank_and_cut(spark, n_shards):
    from pyspark.sql import functions as F

    docs = documents(spark).select("doc_id", "text", "source")
    utf8 = F.coalesce("text", F.lit(""))
    hashed = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"), (F.octet_length(utf8) + 8).cast("long").alias("size"), F.crc32(utf8.cast("binary")).alias("crc"))
    hashed = hashed.withColumn("h", F.xxhash64(F.lit(17), "doc_id", "crc", "size")).withColumn("u", (F.pmod(F.xxhash64(F.lit(17), "s"), F.lit(1 << 30)) + 0.5) / float(1 << 30))
    by = defaultdict(list)
    for r in hashed.collect():
        # sources are ranked by twelve parts of the hash, and by the hash within one
        by[r.s].append(((r.h >> 20) % 12, r.h, -1 if r.doc_id is None else r.doc_id, r.crc, r.size, r.u))
    order = sorted(((i + 1 - x[5]) / len(xs), s, i, x[2], x[4], x[3]) for s, xs in by.items() for i, x in enumerate(sorted(xs)))
    n = len(order)
    want = Counter()
    for place, (*_, d, size, crc) in enumerate(order):
        shard = place * n_shards // n
        want[d, size, crc, shard, place - -(-shard * n // n_shards)] += 1
    got = Counter((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shards(docs, n_shards, parts=12).collect())
    assert got == want


# op8: features, a training step, bounds


def plain_features(word, lexicon, n):
    def hashed(kind, *letters):
        h = kind * language_id.FACTORS[3] & 0xFFFFFFFF
        for c, f in zip(letters, language_id.FACTORS, strict=False):
            h = (h ^ ord(c)) * f & 0xFFFFFFFF
            h ^= h >> 15
        return h % n

    w = f"<{word}>"
    last = len(w) - 1
    out = [hashed(1, *w[:2]), hashed(2, *w[:3]), hashed(3, *(w[min(i, last)] for i in range(4)))]
    out += [hashed(4, *(w[last - i] for i in range(2))), hashed(5, *(w[last - i] for i in range(3))), hashed(6, *(w[max(last - i, 0)] for i in range(4))), hashed(7, chr(lexicon.get(word, -1) + 1))]
    return out + [hashed(8, *w[i : i + 2]) for i in range(len(w) - 1)] + [hashed(9, *w[i : i + 3]) for i in range(len(w) - 2)]


@pytest.mark.parametrize("n", [1 << 16, 1 << 9])
def test_features_of_words(n):
    lexicon = {"bako": 1, "é": 0}
    some = ["bako", "é", "a", "abc", "straße", "Ünïcode", "漢字"]
    flat, bounds = language_id.Features(lexicon, n).ragged(some)
    for w, a, b in zip(some, bounds[:-1], bounds[1:], strict=True):
        assert flat[a:b].tolist() == plain_features(w, lexicon, n)


def test_a_training_step_follows_the_gradient():
    """From zero weights all labels are equally likely, and the first step goes a tenth in the direction of the gradient's sign."""
    rng = random.Random(3)
    rows = [(sentence(rng, g, 30), g) for g in ("aa", "bb", "bb") for _ in range(4)]
    tagger = language_id.train(rows, rounds=1)
    gradient = np.zeros((language_id.FEATURES, 2))
    for text, g in rows:
        for w in text.split():
            for f in plain_features(w, tagger.features.lexicon, language_id.FEATURES):
                gradient[f] += np.eye(2)[["aa", "bb"].index(g)] - 0.5
    assert np.allclose(tagger.weights, 0.1 * np.sign(np.round(gradient, 9)), atol=1e-6)


def test_training_and_labels_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(4)
    rows = [(sentence(rng, g, 200), g) for g in ("aa", "bb") for _ in range(5)]
    some = ["", sentence(rng, "aa", 50) + " " + sentence(rng, "bb", 30), "²", sentence(rng, "bb", 700)]
    whole = language_id.train(rows)
    want = whole.predict(some)
    monkeypatch.setattr(language_id, "CELLS", 300)
    parts = language_id.train(rows)
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and np.allclose(whole.trans, parts.trans, atol=1e-6)
    assert [(p[0], round(p[1], 6), *p[2:]) for p in whole.predict(some)] == [(p[0], round(p[1], 6), *p[2:]) for p in want]
    monkeypatch.setattr(language_id, "SEGMENT", 64)
    cut = whole.predict(some)
    assert [(p[0], *p[2:]) for p in cut] == [(p[0], *p[2:]) for p in want] and all(abs(a[1] - b[1]) < 0.02 for a, b in zip(cut, want, strict=True))


def test_what_has_no_letter_is_undetermined(spark):
    rows = [(i, sentence(random.Random(i), g, 30), g, "s", 0, *["c"] * 9) for i in range(20) for g in [("aa", "bb")[i % 2]]]
    odd = ["² ½", "①", "Ⅷ ⅷ", "́ ̂", "123 ٣٤", "", "\n", None]
    rows += [(100 + i, t, "aa", "s", 0, *["c"] * 9) for i, t in enumerate(odd)] + [(200, "bako²", None, "s", 0, *["c"] * 9)]
    docs = spark.createDataFrame(rows, documents(spark, []).schema).withColumnRenamed("kid", "held_out").withColumnRenamed("th", "score").withColumnRenamed("n", "lang_pred")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(docs).collect()}
    assert all(out[100 + i] == ("und", 0.0) for i in range(len(odd))) and out[200][0] == "aa"


def test_more_than_five_hundred_languages(spark):
    """Every language trains, also one of long documents only; a frequent one takes no other's place."""
    stem = lambda i: chr(97 + i % 26) + chr(97 + i // 26 % 26) + "q" + chr(97 + i % 7)
    rows = [(1000 * i + j, " ".join(stem(i) * 2 + str.lower(chr(97 + (j + k) % 5)) for k in range(12)), f"l{i:03d}") for i in range(520) for j in (1, 2, 3)]
    rows += [(10**6 + j, "common words of one language " * 3, "big") for j in range(2000)]
    rows += [(2 * 10**6 + j, "enormous " * 3000, "long") for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = language_id.sample(docs)
    found = Counter(g for _, g in chosen)
    learnable = {g for d, _, g in rows if zlib.crc32(str(d).encode()) % 4 != 2}
    assert set(found) == learnable and {"big", "long"} <= set(found) and max(found.values()) <= language_id.SAMPLE
    assert sum(len(t) for t, _ in chosen) * len(found) <= language_id.SAMPLE_CELLS
    tagger = language_id.train(chosen, rounds=4)
    assert tagger.weights.size <= language_id.WEIGHTS and len(tagger.langs) == len(learnable)


# op10: detection, keys, surrogates, collisions


SCRIPTS = [
    "Κύριος Γιώργος Παπαδόπουλος και κυρία; Κυρία Μαρία Παπαδόπουλος, Κος Παπαδόπουλος",
    "г-жа Анна Иванова и г-н Иванов", "السيد محمد علي والسيدة", "גברת רות כהן", "श्री राम कुमार", "昨天王小明先生和王芳女士来了。王先生", "田中さん 山田太郎様 スミスさん", "김철수 씨와 김영희님",
    "écrire à élodie@müller.example.com, иван@почта.example.com, γιάννης@ταχυδρομείο.example.com",
]


@pytest.mark.parametrize("rows", [ROWS, SCRIPTS, ROWS + SCRIPTS + ROWS[::-1], [f"{a}{b}@x.example.com" for a in "abcdefghij" for b in "abcdefghij"], [" , ".join(f"{c}@x.example.com" for c in "abcdefghijklmnopqrstuvwxyz")]])
def test_texts_equal_a_plain_version(spark, rows):
    docs = documents(spark, rows).filter("doc_id is not null").dropDuplicates(["doc_id"])
    given = sorted(rows_of(docs))
    got = {r.doc_id: r.text for r in pii.surrogates(docs).collect()}
    assert [got[d] for d, _ in given] == plain_pii.surrogates([t for _, t in given])


def test_names_keep_their_script(spark):
    docs = documents(spark, SCRIPTS)
    out = {r.doc_id: r.text for r in pii.surrogates(docs).collect()}
    for i, own in enumerate(["Γιώργος Παπαδόπουλος Μαρία", "Анна Иванова Иванов", "محمد علي", "רות כהן", "राम कुमार", "王小明 王芳", "田中 山田太郎 スミス", "김철수 김영희", "élodie müller иван почта γιάννης ταχυδρομείο"]):
        assert not any(x in out[i] for x in own.split())
    assert not any("a" <= c <= "z" or "A" <= c <= "Z" for i in (0, 1, 2, 3, 4, 5, 6, 7) for c in out[i])
    a, b = out[5].split("和")
    assert a.endswith("先生") and "女士" in b and b.endswith("先生")


def test_a_format_that_is_full_grows(spark, monkeypatch):
    """All numbers of a format are keys: nothing of it is left as a surrogate, and the job ends."""
    monkeypatch.setattr(pii, "WIDEST", 4)
    found = spark.createDataFrame([("ssn", str(i)) for i in range(10)] + [("phone", str(i)) for i in range(10)], "type string, key string")
    rows = pii.table_of_surrogates(found, "corpus").collect()
    assert len({(r.type, r.core) for r in rows}) == 20 and not {(r.type, r.core) for r in rows} & {(r.type, r.key) for r in rows}
    assert {(r.type, r.key): r.core for r in rows} == plain_pii.table([(r.type, r.key) for r in rows])


# the pipeline


def plain_pipeline(rows):
    """Texts by doc_id after the first four stages."""

    def good(text):
        n, _, _, _, again = measures_brute(text)
        w = (text or "").split()
        far, longest = repeats_brute(w, quality.LONG_WORDS)
        return n >= quality.MIN_WORDS and 100 * again <= quality.BASE_PERCENT * n and 100 * far <= quality.LONG_PERCENT * n and longest <= quality.MAX_REPEAT

    rows = [(d, t) for d, t in rows if good(t)]
    sets = [sets_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, t), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, (d, t)), (d, t))
    rows = sorted(least.values())
    raw = [t.encode() for _, t in rows]
    cut = [bytes(b for b, x in zip(r, gone, strict=True) if not x).decode("utf-8", "ignore") for r, gone in zip(raw, covered(raw, 240), strict=True)]
    return dict(zip([d for d, _ in rows], plain_pii.surrogates(cut), strict=True))


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    passage = " ".join(words(rng, 60, 4000))
    rows = [*texts(7, 40), *(" ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 30)) for _ in range(3)), *(" ".join(words(rng, 15)) + " " + r for r in ROWS if r)]
    docs = documents(spark, rows).filter("doc_id is not null").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    given = rows_of(spark.read.parquet(str(tmp_path / "documents.parquet")))
    want = plain_pipeline(given)
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        now = spark.read.parquet(str(tmp_path / f"s{i}"))
    assert dict(rows_of(now)) == want and 10 < len(want) < len(given) and passage not in " ".join(want.values())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in want.items()}
    seen = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id].append((r.start, r.length))
    assert {d: sum(n for _, n in x) for d, x in seen.items()} == {d: len(x) for d, x in ids.items()}


assert set(LANGS) == {"aa", "bb"}
