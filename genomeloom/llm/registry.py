"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from genomeloom.llm import decontaminate, html_text, jaccard_join, mixing, packing, perplexity, pii, prefix_trie, quality_rules, repair, repeats, secrets, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_pii": pii.op2_pii,
    "op3_html_text": html_text.op3_html_text,
    "op4_perplexity": perplexity.op4_perplexity,
    "op5_secrets": secrets.op5_secrets,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
    "op8_repeats": repeats.op8_repeats,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
    "op11_packing": packing.op11_packing,
    "op12_repair": repair.op12_repair,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op2_pii": pii.ORACLE,
    "op7_ngram_jaccard": jaccard_join.ORACLE,
    "op12_repair": repair.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
