"""The queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from tidemark.llm import bpe, minhash, mixing, pii, quality, quotes, secret_links, subspace, suffix_dedup, warc

QUERIES = {
    "op1_mix_curriculum": mixing.op1,
    "op2_credential_links": secret_links.op2,
    "op3_suffix_repeats": suffix_dedup.op3,
    "op4_minhash_tensored": minhash.op4,
    "op5_subspace_pigeonhole": subspace.op5,
    "op6_word_table_bpe": bpe.op6,
    "op7_feistel_pseudonyms": pii.op7,
    "op8_merkle_fixity": warc.op8,
    "op9_quotation_links": quotes.op9,
    "quotation_links_requoted": quotes.requoted_replies,
    "op10_rule_ledger": quality.op10,
    "rule_ablations": quality.rule_ablations,
}

ORACLE = {
    "op1_mix_curriculum": mixing.OP1_SQL,
    "op2_credential_links": secret_links.OP2_SQL,
    "op4_minhash_tensored": minhash.OP4_SQL,
    "op5_subspace_pigeonhole": subspace.OP5_SQL,
    "op8_merkle_fixity": warc.OP8_SQL,
    "op9_quotation_links": quotes.OP9_SQL,
    "quotation_links_requoted": quotes.REQUOTED_SQL,
    "op10_rule_ledger": quality.OP10_SQL,
    "rule_ablations": quality.ABLATIONS_SQL,
}
