"""One query per operator over the whole ``documents`` or ``conversations`` table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, flac, lines, lm, packing, prefixes, quality, repair, secrets, sharding, simhash, substrings, wavelet
from .common import conversations, documents, stored, unsigned_crc32
from .oracles import ORACLES as ORACLES

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), WORD_VOCABULARY, capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", unsigned_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=40)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lines.drop_frequent(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(documents(spark, sf_dir), BYTE_RANKS)
    decoded = byte_bpe.decode(encoded, BYTE_RANKS)
    return decoded.select("doc_id", "n_tokens", F.sha2("decimals", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(flac.encode(documents(spark, sf_dir)), "media")
    decoded = flac.decode(media)
    return decoded.select(
        "doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        unsigned_crc32(F.substring("pcm", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", "block_starts", "error",
    )


def op6_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = wavelet.write(documents(spark, sf_dir), BYTE_VOCABULARY, end_id=2)
    return wavelet.read(files).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), unsigned_crc32(F.col("ids")).alias("ids_crc32"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substrings.removed(docs, window=50).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), width=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality.ordered(quality.RULES, quality.estimate(docs))
    return quality.judge(docs, rules, measures=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), columns=["doc_id"])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(prefixes.rebuilt(conversations(spark, sf_dir)))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir)
    repaired = repair.repaired(repair.damaged(turns))
    return repair.with_all(repaired, turns)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir), columns=["doc_id"])
    counts = (secrets.counted("spans", kind).alias(f"n_{kind}") for kind in secrets.BASE)
    return found.select("doc_id", *counts, F.sha2(secrets.written("spans", secrets.BASE), 256).alias("base_sha256"), secrets.written("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_flac_media": op5_flac_media,
    "op6_wavelet_matrix": op6_wavelet_matrix,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_secret_scan": op13_secret_scan,
}
