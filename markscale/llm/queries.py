"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markscale.llm import (
    chat_format, decontaminate, html_extract, line_spread, merkle_manifest, mixing, ngram_join, quality_mil, sharding, stream_dedup, token_alignment,
    url_filters, warc_zip,
)
from markscale.llm.common import table
from markscale.session import configure, scratch_path

SHARDS = 16
QUALITY_THRESHOLD = 0.3

URL_RULES = (
    url_filters.Rule("allow", "com"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
)


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = sharding.assign_grown(narrow, "doc_id", [1.0] * SHARDS)
    return sharding.number_slots(rows, ["doc_id", "size", "text_crc32"])


def line_spread_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_spread.remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    path = scratch_path(spark, "warc")
    warc_zip.write_packages(table(spark, sf_dir, "pages"), path)
    return warc_zip.read_packages(
        spark, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    )


def ngram_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    found = ngram_join.similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), "class_id", "n_links")


def stream_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_dedup.stream_dedup(spark, f"{sf_dir}/documents.parquet")
    return rows.select(
        F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judge_documents(docs, table(spark, sf_dir, "benchmark"))
    counted = found.select(
        F.col("key").alias("doc_id"), "n_words", decontaminate.hit_words(F.col("hits")).alias("n_hit"),
        decontaminate.hit_items(F.col("hits")).alias("items"),
    )
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"))
    return quality_mil.add_score(docs, model).select(
        "doc_id",
        (quality_mil.id_remainder(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    rows = mix.taken().join(mix.sources.select("sid", "source_size", "target"), "sid")
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_main_text(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


def token_alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    scored, _ = token_alignment.align(table(spark, sf_dir, "documents"))
    return scored.withColumnRenamed("groups", "groups_sha256")


#: A conversation of its own whose texts hold the template's marks.
MARKED = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def as_records(conversations: DataFrame) -> DataFrame:
    """Every conversation as one JSON object, in one of the layouts that its turns fit, picked by its id."""
    turns = F.col("turns")
    texts, roles = F.col("turns.text"), F.col("turns.role")
    pick = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))

    def listed(path: str, role: str, text: str, named=lambda r: r) -> Column:
        return F.transform(turns, lambda t: F.struct(named(t["role"]).alias(role), t["text"].alias(text))).alias(path)

    def from_role(role):
        return F.when(role == "user", F.lit("human")).when(role == "assistant", F.lit("gpt")).otherwise(role)

    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    triple = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    system = F.when(triple, texts[0])
    user, answer = F.element_at(texts, -2), F.element_at(texts, -1)
    cut = F.instr(user, "\n")
    split = (cut > 1) & (cut < F.char_length(user))
    first = F.when(split, F.substring(user, F.lit(1), cut - 1)).otherwise(user)
    rest = F.when(split, F.substring(user, cut + 1, F.char_length(user)))
    known = F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
    record = (
        F.when((pick == 1) & known, F.to_json(F.struct(listed("conversations", "from", "value", from_role))))
        .when((pick == 2) & (pair | triple), F.to_json(F.struct(system.alias("system"), first.alias("instruction"), rest.alias("input"), answer.alias("output"))))
        .when((pick == 3) & (pair | triple), F.to_json(F.struct(system.alias("system"), user.alias("prompt"), answer.alias("response"))))
        .when(pick == 4, F.to_json(F.struct(F.struct(listed("turns", "speaker", "utterance")).alias("dialog"))))
        .otherwise(F.to_json(F.struct(listed("messages", "role", "content"))))
    )
    return conversations.select("conv_id", record.alias("record"))


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(MARKED, rows.schema))
    records = as_records(chat_format.turns_of_rows(rows, "conv_id"))
    formatted = chat_format.render(chat_format.canonical_turns(records, "record"))
    found = chat_format.read_back(formatted)
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), chat_format.turns_digest(F.col("turns")).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    fields = ("doc_id", "source", "lang", "n_chars")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = docs.select(
        "doc_id", "source",
        merkle_manifest.leaf(*map(F.col, fields), text).alias("leaf"),
        F.when(hit, merkle_manifest.leaf(*map(F.col, fields), F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"),
    )
    found = merkle_manifest.manifest(rows, "source", "doc_id", "leaf")
    folded = found.withColumn("folded_root", merkle_manifest.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op1_rendezvous_sharding": sharding_query,
    "op2_line_spread": line_spread_query,
    "op3_url_filter": url_filter_query,
    "op4_warc_zip": warc_query,
    "op5_ngram_join": ngram_join_query,
    "op6_stream_dedup": stream_dedup_query,
    "op7_decontamination": decontamination_query,
    "op8_quality_mil": quality_query,
    "op9_source_mix": mixing_query,
    "op10_main_text": html_query,
    "op11_token_alignment": token_alignment_query,
    "op12_chat_format": chat_query,
    "op13_merkle_manifest": merkle_query,
}
