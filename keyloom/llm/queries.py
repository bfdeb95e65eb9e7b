"""The thin queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan

    return scan(_read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import as_table
    from .warc import merge_runs, read_records, write_archives

    index = as_table(merge_runs(write_archives(_read(spark, sf_dir, "pages"))), "index")
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, fitted

    docs = _read(spark, sf_dir, "documents")
    return classify(docs, fitted(docs, _read(spark, sf_dir, "labels")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fitted, grade_documents

    docs = _read(spark, sf_dir, "documents")
    return grade_documents(docs, fitted(docs, _read(spark, sf_dir, "labels")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece import encode_decode

    return encode_decode(_read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idfile import read_id_files, write_id_files

    return read_id_files(write_id_files(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bagminhash import classes

    return classes(_read(spark, sf_dir, "documents"))


def op9_block_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .blockann import nearest

    rows = _read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import features, store, tensor_table

    return features(tensor_table(store(_read(spark, sf_dir, "documents"))))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_warc_index, op4_quality_classifier, op5_toxicity, op6_sentencepiece, op7_token_files, op8_bagminhash, op9_block_matrix_join, op10_audio_features)}


_WARC_SQL = """
    with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
    w as (select payload_digest, payload_bytes, max(page_id) as winner from p where payload_bytes >= 1000 group by all)
    select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
        case when winner is null or winner is not distinct from page_id then 'response' else 'revisit' end as record_type,
        case when winner is not null and winner is distinct from page_id then winner end as refers_to
    from p left join w using (payload_digest, payload_bytes)"""

_NEAREST_SQL = """
    with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) as score
        from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
    r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
    select * from r where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    from .license import scan_sql

    return {"op1_license_scan": scan_sql(), "op3_warc_index": _WARC_SQL, "op9_block_matrix_join": _NEAREST_SQL}
