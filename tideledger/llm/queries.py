"""Registered queries of the training-data operators: thin digests of their real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.llm import conversations, decontamination, jaccard_join, language, merkle, mixing, quality, sentence_pieces, substrings, token_file, toxicity, vector_codes, warc
from tideledger.llm.shared import Workspace, remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_token_file")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").path("ids")
    token_file.write(table(spark, sf_dir, "documents"), path, word_tokenizer())
    return token_file.directory(spark, path)


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query("op3_warc")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, revisits by their headers alone."""
    path = Workspace(spark, "warc").path("archive")
    warc.write(table(spark, sf_dir, "pages"), path)
    own = warc.read(spark, path).where("record_type = 'response'")
    own = own.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    again = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select("record_id", F.col("http_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", "refers_to")
    return own.unionByName(again).select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "position")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language.train(docs.where(~held_out), "doc_id", "text", "lang")
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), F.col("_language.lang").alias("lang_pred"), "_language.score")


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 3) == 1
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 4) == 2
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85, inside="solid")
    return found.select("doc_id", "n_shingles", "component_id")


@query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_sentence_pieces")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = sentence_pieces.encode(table(spark, sf_dir, "documents"), piece_model())
    told = sentence_pieces.decode(tokens, piece_model())
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return told.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(table(spark, sf_dir, "conversations"))


@query("op13_vector_codes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))
