"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tracemill.llm import bpe, decontamination, html_extraction, lm_scoring, minhash, phrases, prefix_trie, quality_rules, sharding, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "quality_ablations": quality_rules.quality_ablations,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_warc": warc.op4_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simhash": simhash.op6_simhash,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_bpe": bpe.op9_bpe,
    "op10_html_extraction": html_extraction.op10_html_extraction,
    "op11_minhash": minhash.op11_minhash,
    "op12_phrases": phrases.op12_phrases,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "quality_ablations": quality_rules.ABLATIONS_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op8_sharding": sharding.ORACLE_SQL,
    "op12_phrases": phrases.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
