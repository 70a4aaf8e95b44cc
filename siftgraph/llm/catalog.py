"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    arc_warc, collocations, crf_langid, exact_dedup, gru_toxicity, merge_dropout, mixing, pivot_topk, prefix_trie, sharding,
    suffix_dedup, token_arrow, trie_join,
)
from .common import hash_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_suffix_dedup")
def _suffixes(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


@query("op2_warc_from_arc", arc_warc.SQL)
def _warc(spark, sf):
    return arc_warc.round_trip(spark, table(spark, sf, "pages"))


@query("op3_mix_sources", mixing.SQL)
def _mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).drop("row")


@query("op4_token_files")
def _tokens(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_arrow.token_files(spark, table(spark, sf, "documents"), path, plain=False)


@query("op5_ngram_join")
def _near(spark, sf):
    return trie_join.near_groups(table(spark, sf, "documents"))


@query("op6_pivot_top_k", pivot_topk.SQL)
def _top_k(spark, sf):
    return pivot_topk.pivot_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_merge_dropout")
def _pieces(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return merge_dropout.encode_dropout(table(spark, sf, "documents"), path)


@query("op8_exact_dedup", exact_dedup.SQL)
def _exact(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents")).drop("row")


@query("op9_language_crf")
def _language(spark, sf):
    docs, held = table(spark, sf, "documents"), hash_fold("doc_id", 4) == 2
    found = crf_langid.identify(docs, crf_langid.fit(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op10_toxicity_gru")
def _toxicity(spark, sf):
    docs, held = table(spark, sf, "documents"), hash_fold("doc_id", 3) == 1
    found = gru_toxicity.toxicity(docs, gru_toxicity.fit(docs, table(spark, sf, "labels"), ~held))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op11_phrase_streams", collocations.SQL)
def _phrases(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


@query("op12_conversation_trie", prefix_trie.SQL)
def _conversations(spark, sf):
    return prefix_trie.conversation_trie(table(spark, sf, "conversations"))


@query("op13_rendezvous_shards", sharding.SQL)
def _shards(spark, sf):
    return sharding.shard_rows(table(spark, sf, "documents"))
