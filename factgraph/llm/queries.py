"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import bpe_lexicon, decontaminate, fill_middle, html_text, language_id, license_scan, ngram_join, ngram_lm, prefix_trie, sentencepiece_codec, suffix_dedup, topk, url_filter
from .common import table


def tokenizer_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark, sf_dir) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op3_lm_score(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_lm.score(docs, ngram_lm.train(docs))


def op4_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op5_suffix_dedup(spark, sf_dir) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_sentencepiece(spark, sf_dir) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_model())


def op7_top_k(spark, sf_dir) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_html_text(spark, sf_dir) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark, sf_dir) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_ngram_join(spark, sf_dir) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op11_bpe(spark, sf_dir) -> DataFrame:
    return bpe_lexicon.encode_decode(table(spark, sf_dir, "documents"), tokenizer_model("byte_bpe_50k.json"))


def op12_fill_middle(spark, sf_dir) -> DataFrame:
    return fill_middle.fill_middle(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_url_filter, op3_lm_score, op4_language_id, op5_suffix_dedup, op6_sentencepiece, op7_top_k, op8_html_text, op9_decontaminate, op10_ngram_join,
                                   op11_bpe, op12_fill_middle, op13_prefix_trie)}
SQL = {"op2_url_filter": url_filter.ORACLE, "op7_top_k": topk.ORACLE, "op12_fill_middle": fill_middle.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
