"""One query per corpus operator, over its whole table, and plain SQL where it can say the same."""

from __future__ import annotations

from . import chat, codes, decontamination, embeddings, minhash, mixing, packing, pii, quality, repair, secrets, toxicity, urlfilter
from .common import table


def pipeline(spark, sf_dir):
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {
    "op1_embedding_near_dedup": lambda spark, d: embeddings.near_duplicates(table(spark, d, "embeddings")),
    "op2_decontamination": lambda spark, d: decontamination.report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op3_chat_formatting": lambda spark, d: chat.report(table(spark, d, "conversations")),
    "op4_toxicity": lambda spark, d: toxicity.report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_secret_scan": lambda spark, d: secrets.report(table(spark, d, "documents")),
    "op6_url_filter": lambda spark, d: urlfilter.judge(table(spark, d, "pages")),
    "op7_minhash_near_dedup": lambda spark, d: minhash.near_duplicates(table(spark, d, "documents")),
    "op8_quality": lambda spark, d: quality.report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_pii": lambda spark, d: pii.report(table(spark, d, "documents")),
    "op10_packing": lambda spark, d: packing.pack(table(spark, d, "documents"), tokenizer_path()),
    "op11_structure_repair": lambda spark, d: repair.report(table(spark, d, "conversations")),
    "op12_vector_codes": lambda spark, d: codes.report(table(spark, d, "embeddings")),
    "op13_source_mixing": lambda spark, d: mixing.report(table(spark, d, "documents")),
    "pipeline": pipeline,
}

SQL = {
    "op1_embedding_near_dedup": embeddings.SQL,
    "op3_chat_formatting": chat.SQL,
    "op6_url_filter": urlfilter.SQL,
    "op11_structure_repair": repair.SQL,
    "op12_vector_codes": codes.SQL,
    "op13_source_mixing": mixing.SQL,
}
