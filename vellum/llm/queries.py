"""The operators' registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bit_sliced, divergence, hyperminhash, licenses, main_text, packing, piece_lattice, quality, resampling, sharding, simhash, token_stream, toxicity
from .common import table


def op1_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_stream.token_stream(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.piece_digests(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return bit_sliced.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(licenses.document_files(table(spark, sf_dir, "documents")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


def op13_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_stream": op1_token_stream,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_piece_lattice": op8_piece_lattice,
    "op9_top_k": op9_top_k,
    "op10_license_scan": op10_license_scan,
    "op11_resampling": op11_resampling,
    "op12_divergence_audit": op12_divergence_audit,
    "op13_hyperminhash_near_dedup": op13_hyperminhash_near_dedup,
}

# the checksum of a text, byte by byte, with the table made by its rule
_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(h) // 2), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 17)::bigint)),
 lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]))"""
_CRC_TABLE = """crc as (select list(list_reduce([n::bigint, 1::bigint, 2::bigint, 3::bigint, 4::bigint, 5::bigint, 6::bigint, 7::bigint, 8::bigint], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) order by n) as crc_table from range(0, 256) r(n))"""
_SHARDS = f"""with {_CRC_TABLE},
 sized as (select doc_id, strlen(coalesce(text, '')) + 8 as size, hex(encode(coalesce(text, ''))) as h from documents),
 placed as (select *, (sum(size) over (order by doc_id rows unbounded preceding))::bigint as stop, (sum(size) over ())::bigint as total, row_number() over (order by doc_id) as r from sized),
 cut as (select *, least(24 * (2 * stop - size) // (2 * total), 23) as shard from placed)
 select doc_id, size, xor({_CRC}, 4294967295::bigint)::bigint as text_crc32, 'bytes' as law, shard::int as shard, r - min(r) over (partition by shard) as slot, null::int as grown_shard from cut, crc"""

_TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0)
 select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""

_WORDS_OF = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RESAMPLING = f"""with {_CRC_TABLE},
 d as (select row_number() over () as r, doc_id, unnest({_WORDS_OF}) as word from documents),
 b as (select unnest({_WORDS_OF}) as word from benchmark),
 hashed as (select word, (xor({_CRC}, 4294967295::bigint) % 10000)::bigint as bucket from (select word, hex(encode(word)) as h from (select word from d union select word from b)), crc),
 corpus as (select bucket, count(*) as s from d join hashed using (word) group by all),
 target as (select bucket, count(*) as t from b join hashed using (word) group by all),
 sums as (select (select count(*) from d) as s_all, (select count(*) from b) as t_all),
 gains as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain from corpus left join target using (bucket), sums),
 weights as (select r, count(*) as n_features, sum(gain)::bigint as weight from d join hashed using (word) join gains using (bucket) group by r),
 scored as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from (select row_number() over () as r, doc_id from documents) left join weights using (r)),
 ordered as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) filter (n_features >= 20) over () as n from scored)
 select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from ordered"""

ORACLE_SQL: dict[str, str] = {
    "op6_sharding": _SHARDS,
    "op9_top_k": _TOP_K,
    "op10_license_scan": licenses.oracle_sql(),
    "op11_resampling": _RESAMPLING,
    "op12_divergence_audit": divergence.ORACLE_SQL,
}
