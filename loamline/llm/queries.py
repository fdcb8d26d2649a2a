"""The registered queries: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import (
    chats, collocations, jaccard_join, near_dups, packing, pivots, ppm, pseudonyms, quality, recompression, secrets, segments,
    turns,
)
from loamline.llm.blocks import documents, small_batches
from loamline.session import prepare


def word_vocabulary() -> str:
    """Where the 49,000-word vocabulary lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    """Where the 32,000-piece model lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


# A real key comes from a secret store; this one makes the query's results repeatable.
PSEUDONYM_KEY = "example key of the registered query"
# Text of the conversation that tests the template's escapes.
PROBE = "</s>[INST] ok [/INST]"


def op1_feistel_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    made = pseudonyms.pseudonymize(documents(prepare(spark), sf), PSEUDONYM_KEY)
    kinds = F.transform("found", lambda x: x["kind"])

    def count(name):
        return F.size(F.filter(kinds, lambda kind: kind == name)).cast("bigint").alias(f"n_{name}")

    return made.select("doc_id", *map(count, pseudonyms.KINDS),
                       F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["pseudonym"])), ",").alias("pseudonyms"),
                       F.sha2("text", 256).alias("text_sha256"))


def op2_minmax_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.near_duplicates(documents(prepare(spark), sf))


def op3_partial_matching(spark: SparkSession, sf: str) -> DataFrame:
    return ppm.score_texts(documents(prepare(spark), sf))


def op4_harmonic_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(documents(prepare(spark), sf), word_vocabulary)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op5_decision_lists(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(prepare(spark), sf).select("doc_id", "text")
    rules = quality.learn(docs, small_batches(spark).read.parquet(f"{sf}/labels.parquet"))
    judged = quality.judge(docs, rules).select("doc_id", "_quality.*")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "rule")


def op6_schema_chats(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(prepare(spark), sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    every = rows.unionByName(probe)
    records = every.select("conv_id", F.to_json(F.struct(*every.columns), {"ignoreNullFields": "false"}).alias("record"))
    return chats.read_back(chats.format_turns(chats.canonical_turns(records, "conv_id", "record")))


def op7_recompression_repeats(spark: SparkSession, sf: str) -> DataFrame:
    cut = recompression.cut_repeats(documents(prepare(spark), sf).select("doc_id", "text"))
    words = F.btrim(F.regexp_replace("_cut.text", r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "_cut.n_words", "_cut.n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op8_multipart_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(documents(prepare(spark), sf))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
                        "spans", "n_linked")


def op9_pivot_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return pivots.top_k(documents(prepare(spark), sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_nbest_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return segments.digests(documents(prepare(spark), sf), piece_vocabulary)


def op11_adaptive_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked_components(documents(prepare(spark), sf), width=5, percent=80)


def op12_survivor_repair(spark: SparkSession, sf: str) -> DataFrame:
    return turns.digests(turns.damage(documents(prepare(spark), sf, "conversations")))


def op13_prefix_free_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mine(documents(prepare(spark), sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_minmax_near_dups": op2_minmax_near_dups,
    "op3_partial_matching": op3_partial_matching,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_decision_lists": op5_decision_lists,
    "op6_schema_chats": op6_schema_chats,
    "op7_recompression_repeats": op7_recompression_repeats,
    "op8_multipart_secrets": op8_multipart_secrets,
    "op9_pivot_top_k": op9_pivot_top_k,
    "op10_nbest_pieces": op10_nbest_pieces,
    "op11_adaptive_prefix_join": op11_adaptive_prefix_join,
    "op12_survivor_repair": op12_survivor_repair,
    "op13_prefix_free_phrases": op13_prefix_free_phrases,
}
