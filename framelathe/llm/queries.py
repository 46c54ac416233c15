"""The subpackage's queries and their SQL."""

from . import embedding_dedup, html_extraction, mixing, quality_rules, sentencepiece_codec, simhash_dedup, substring_dedup, toxicity, url_filters, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_query,
    "op2_embedding_dedup": embedding_dedup.op2_query,
    "op3_simhash_dedup": simhash_dedup.op3_query,
    "op4_url_filters": url_filters.op4_query,
    "op5_html_extraction": html_extraction.op5_query,
    "op6_substring_dedup": substring_dedup.op6_query,
    "op7_warc": warc.op7_query,
    "op8_toxicity": toxicity.op8_query,
    "op9_mixing": mixing.op9_query,
    "op10_sentencepiece": sentencepiece_codec.op10_query,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_embedding_dedup": embedding_dedup.ORACLE,
    "op4_url_filters": url_filters.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
