"""Queries of the training-data operators: one for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bit_planes, fingerprints, language_id, merkle, ngram_join, packing, pii, prefix_trie, quality, sentencepiece_codec, sharding, suffix_dedup, token_counts
from .common import documents


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).drop("n_long_repeat_words", "longest_repeat")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trips(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_report(documents(spark, sf_dir))


def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.id_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_quality_rules,
        op3_packing,
        op4_token_counts,
        op5_fingerprints,
        op6_sentencepiece,
        op7_suffix_dedup,
        op8_language_id,
        op9_sharding,
        op10_pii_surrogates,
        op11_bit_planes,
        op12_prefix_trie,
        op13_merkle_manifest,
    )
}

WORDS = r"""regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"""
LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a number's digits, bit by bit.
CRC = """xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({x}::varchar, ''), lambda d: ascii(d)::bigint)), lambda s, d: list_reduce(list_prepend(xor(s, d), [0,0,0,0,0,0,0,0]::bigint[]), lambda v, z: xor(v // 2, (v % 2) * 3988292384))))"""
FIELD = "coalesce(strlen({x}::varchar)::varchar||':'||{x}::varchar, '-')"
LEAF = "sha256(" + "||".join(FIELD.format(x=x) for x in ("doc_id", "source", "lang", "n_chars")) + "||{text})"
LOWERED = "translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": f"""with recursive w as (select doc_id, {WORDS.format(text=LOWER)} w from documents),
 s as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i+4],' ') else array_to_string(w,' ') end s from w, unnest(range(1, greatest(1, len(w)-4)+1)) t(i) where len(w) > 0),
 n as (select doc_id, count(*) n from s group by doc_id),
 p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100*k >= 75*(x.n+y.n-k)),
 both_ways as (select a, b from e union all select b, a from e),
 r as (select doc_id, doc_id c from documents union select g.b, r.c from r join both_ways g on r.doc_id = g.a)
 select d.doc_id, coalesce(n.n, 0) n_shingles, c.c component_id from documents d left join n on n.doc_id = d.doc_id join (select doc_id, min(c) c from r group by doc_id) c on c.doc_id = d.doc_id""",
    "op2_quality_rules": f"""with w as (select doc_id, coalesce(text,'') text, {WORDS.format(text="coalesce(text,'')")} w from documents),
 k as (select unnest([{quality.WINDOW}, {quality.LONG_WORDS}, {quality.MAX_REPEAT + 1}]) k),
 v as (select doc_id, k, i, hash(w[i:i+k-1]) h from w, k, unnest(range(1, greatest(0, len(w)-k+1)+1)) t(i)),
 twice as (select doc_id, k, i from (select *, count(*) over (partition by doc_id, k, h) c from v) where c > 1),
 gone as (select doc_id, k, sum(least(k, coalesce(later-i, k))) n from (select *, lead(i) over (partition by doc_id, k order by i) later from twice) group by doc_id, k),
 lines as (select doc_id, count(*)-count(distinct l) n from (select doc_id, unnest(string_split(text, chr(10))) l from w) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id),
 m as (select doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) word_chars, length(text)-length(translate(text,'#*$%&|<>','')) n_symbols,
  coalesce((select n from lines where lines.doc_id = w.doc_id), 0) n_dup_lines,
  coalesce((select n from gone g where g.doc_id = w.doc_id and k = {quality.WINDOW}), 0) n_repeat_words, coalesce((select n from gone g where g.doc_id = w.doc_id and k = {quality.LONG_WORDS}), 0) far, coalesce((select n from gone g where g.doc_id = w.doc_id and k = {quality.MAX_REPEAT + 1}), 0) too_long from w)
 select doc_id, n_words, cast(word_chars as bigint) word_chars, n_symbols, n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, n_words < {quality.MIN_WORDS} or 100*n_repeat_words > {quality.BASE_PERCENT}*n_words base_failed,
  not (n_words < {quality.MIN_WORDS} or 100*n_repeat_words > {quality.BASE_PERCENT}*n_words) and 100*far <= {quality.LONG_PERCENT}*n_words and too_long = 0 kept from m""",
    "op12_prefix_trie": f"""with t as (select conv_id, turn, strlen(coalesce(text,'')) size, left(sha256(strlen(coalesce(role,''))::varchar||':'||coalesce(role,'')||coalesce(text,'')), 32) dig from conversations where conv_id is not null),
 o as (select *, row_number() over (partition by conv_id order by turn nulls first, dig) i from t),
 ids as (select conv_id c, {CRC.format(x="conv_id")} % 9 h, conv_id - conv_id % 5 f, (select count(*) from t b where b.conv_id = a.conv_id - a.conv_id % 5) k from (select distinct conv_id from t) a),
 r as (select c, o.i d, dig, size from ids join o on o.conv_id = f and o.i <= h union all select c, o.i-h+least(h, k), dig, size from ids join o on o.conv_id = c and o.i > h),
 p as (select c, d, string_agg(dig,'') over (partition by c order by d) path, size from r union all select c, 0, '', 0 from ids),
 v as (select path, d depth, min(c) conv_id, count(*) n, any_value(size) size from p group by path, d),
 s as (select a.path, count(*) filter (not exists (select 1 from v y where y.depth = x.depth+1 and starts_with(y.path, x.path))) leaves, sum((x.n-1)*x.size) saved, count(*) filter (x.depth = a.depth+1) children from v a join v x on starts_with(x.path, a.path) group by a.path),
 e as (select path, sha256(string_agg(c::varchar, ',' order by c)) h from (select c, max_by(path, d) path from p group by c) group by path)
 select v.conv_id, v.depth, u.conv_id parent_conv_id, v.n n_convs, s.children n_children, s.leaves n_leaves, cast(s.saved as bigint) saved_tokens, coalesce(e.h, sha256('')) ends_sha256
 from v join s on s.path = v.path left join v u on v.depth > 0 and u.path = left(v.path, -32) left join e on e.path = v.path""",
    "op13_merkle_manifest": f"""with recursive l as (select doc_id, coalesce('='||lang,'') tree, {LEAF.format(text=FIELD.format(x="text"))} leaf, case when doc_id is not null and {CRC.format(x="doc_id")} % 3 = 0 then {LEAF.format(text=FIELD.format(x=LOWERED))} end changed from documents),
 d as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf)-1 pos, count(*) over (partition by tree) n from l),
 low as (select tree, 0 k, pos, n, leaf digest from d union all select tree, k+1, pos//8, (n+7)//8, sha256(string_agg(digest,'' order by pos)) from low where n > 1 group by tree, k, n, pos//8),
 tops as (select tree, digest, row_number() over (order by tree)-1 pos, count(*) over () n from low where n = 1),
 high as (select 0 k, pos, n, digest from tops union all select k+1, pos//8, (n+7)//8, sha256(string_agg(digest,'' order by pos)) from high where n > 1 group by k, n, pos//8),
 s1 as (select d.tree, d.pos, low.k, coalesce(string_agg(digest,'' order by low.pos) filter (low.pos < d.pos >> (3*low.k)),'') a, coalesce(string_agg(digest,'' order by low.pos) filter (low.pos > d.pos >> (3*low.k)),'') b
  from d join low on low.tree = d.tree and low.n > 1 and low.pos//8 = d.pos >> (3*low.k+3) group by all),
 s2 as (select t.tree, high.k, coalesce(string_agg(high.digest,'' order by high.pos) filter (high.pos < t.pos >> (3*high.k)),'') a, coalesce(string_agg(high.digest,'' order by high.pos) filter (high.pos > t.pos >> (3*high.k)),'') b
  from tops t join high on high.n > 1 and high.pos//8 = t.pos >> (3*high.k+3) group by all),
 steps as (select *, row_number() over (partition by tree, pos order by k) i from (select tree, pos, k, a, b from s1 union all select d.tree, d.pos, 100+s2.k, s2.a, s2.b from d join s2 on s2.tree = d.tree)),
 fold as (select tree, pos, cast(0 as bigint) i, coalesce(changed, leaf) node from d union all select f.tree, f.pos, s.i, sha256(s.a||f.node||s.b) from fold f join steps s on s.tree = f.tree and s.pos = f.pos and s.i = f.i+1),
 ends as (select tree, pos, max_by(node, i) node from fold group by all), proofs as (select tree, pos, sha256(string_agg(a||b,'' order by k)) p from steps group by all)
 select d.doc_id, d.leaf, t.digest subroot, r.digest root, coalesce(p.p, sha256('')) proof_sha256, e.node folded_root, e.node = r.digest verified
 from d join tops t on t.tree = d.tree join (select digest from high where n = 1) r on true join ends e on e.tree = d.tree and e.pos = d.pos left join proofs p on p.tree = d.tree and p.pos = d.pos""",
}
