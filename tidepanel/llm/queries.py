"""The registered queries of this subpackage: one per operator, over its
whole table, with its production parameters; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bagminhash,
    bpe,
    packing,
    prefix_trie,
    quality_fm,
    rlz,
    secret_scan,
    suffix_family,
    vector_codes,
)
from .common import table
from .content_sort import content_sort_dedup
from .decontaminate import decontaminate
from .license_scan import license_scan, oracle as license_oracle
from .token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_rlz_substring_dedup")
def op1(spark, sf_dir):
    return rlz.rlz_digest(rlz.rlz_dedup(table(spark, sf_dir, "documents")))


@query("op2_bpe_roundtrip")
def op2(spark, sf_dir):
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


@query("op3_bagminhash_near_dedup")
def op3(spark, sf_dir):
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).drop("mark")


@query("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


@query("op5_content_sort_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM d WINDOW g AS (PARTITION BY t)""")
def op5(spark, sf_dir):
    return content_sort_dedup(table(spark, sf_dir, "documents"), keep="max")


# documents have no file names: a source is a folder, its languages are below it
@query("op6_license_scan", license_oracle("concat_ws('/', source, lang, doc_id)"))
def op6(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"),
                        F.concat_ws("/", "source", "lang", "doc_id"))


@query("op7_benchmark_decontamination")
def op7(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated")


@query("op8_quality_fm")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model).select(
        "doc_id", (quality_fm.fold() == 0).alias("held_out"), "score", "predicted")


@query("op9_sequence_packing")
def op9(spark, sf_dir):
    return packing.pack_digest(packing.pack(table(spark, sf_dir, "documents"),
                                            bpe.default_vocabulary("byte_bpe_50k.tiktoken")))


@query("op10_suffix_family_dedup")
def op10(spark, sf_dir):
    return suffix_family.suffix_digest(
        suffix_family.suffix_dedup(table(spark, sf_dir, "documents")))


@query("op11_conversation_trie", prefix_trie.ORACLE)
def op11(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_secret_scan", secret_scan.oracle())
def op12(spark, sf_dir):
    return secret_scan.secret_digest(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


@query("op13_vector_codes", vector_codes.oracle())
def op13(spark, sf_dir):
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).drop("label")
