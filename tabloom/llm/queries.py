"""The queries of this subpackage and their SQL equivalents (none where SQL cannot express one)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (language, packing, pieces, pii, sharding, shingle_join, source_mix, toxicity, turn_trie, urls, vector_codes, vector_dedup,
               vector_search)
from .common import read


def op1_pii(spark, sf):
    return pii.counts(pii.find_pii(read(spark, sf, "documents")))


def op2_ngram_join(spark, sf):
    return shingle_join.near_duplicate_components(read(spark, sf, "documents"))


def op3_language_id(spark, sf):
    docs = read(spark, sf, "documents")
    out = toxicity.held_out("doc_id", 4, 2)
    found = language.identify(docs, language.fit(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_url_filter(spark, sf):
    return urls.judge_urls(read(spark, sf, "pages"))


def op5_vector_dedup(spark, sf):
    return vector_dedup.link_vectors(read(spark, sf, "embeddings"))


def op6_packing(spark, sf):
    return packing.pack(read(spark, sf, "documents"))


def op7_sentencepiece(spark, sf):
    both = pieces.decode(pieces.encode(read(spark, sf, "documents")))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(ids).alias("ids_md5"), F.md5("decoded").alias("decoded_md5"))


def op8_nearest(spark, sf):
    return vector_search.nearest_neighbours(read(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_sharding(spark, sf):
    placed = sharding.shard_documents(read(spark, sf, "documents"), sharding.TREE_24, sharding.grown(sharding.TREE_24))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def op10_toxicity(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    out = toxicity.held_out("doc_id", 5, 0)
    scores = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels.filter(~out)))
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_turn_trie(spark, sf):
    return turn_trie.prefix_trie(read(spark, sf, "conversations"))


def op12_vector_codes(spark, sf):
    return vector_codes.vector_codes(read(spark, sf, "embeddings"))


def op13_source_mix(spark, sf):
    return source_mix.mix_documents(read(spark, sf, "documents"))


QUERIES = {q.__name__: q for q in (op1_pii, op2_ngram_join, op3_language_id, op4_url_filter, op5_vector_dedup, op6_packing,
                                   op7_sentencepiece, op8_nearest, op9_sharding, op10_toxicity, op11_turn_trie, op12_vector_codes,
                                   op13_source_mix)}
SQL = {"op4_url_filter": urls.url_sql(), "op11_turn_trie": turn_trie.trie_sql(), "op12_vector_codes": vector_codes.codes_sql(),
       "op13_source_mix": source_mix.mix_sql()}
