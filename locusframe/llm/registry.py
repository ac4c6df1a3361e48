"""The queries of this subpackage and the SQL of those that SQL can express."""

from locusframe.llm import decontamination, embedding_dedup, html_extract, line_dedup, merkle, packing, pii, sharding, simhash, substring_dedup, suffix_dedup, toxicity, trie

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_packing": packing.query,
    "op3_html_main_text": html_extract.query,
    "op4_toxicity": toxicity.query,
    "op5_decontamination": decontamination.query,
    "op6_simhash_bk": simhash.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_line_dedup": line_dedup.query,
    "op9_pii": pii.query,
    "op10_embedding_dedup": embedding_dedup.query,
    "op11_merkle": merkle.query,
    "op12_prefix_trie": trie.query,
    "op13_suffix_dedup": suffix_dedup.query,
}
SQL = {
    "op1_sharding": sharding.SQL,
    "op5_decontamination": decontamination.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_embedding_dedup": embedding_dedup.SQL,
    "op11_merkle": merkle.SQL,
    "op12_prefix_trie": trie.SQL,
    "op13_suffix_dedup": suffix_dedup.SQL,
}
