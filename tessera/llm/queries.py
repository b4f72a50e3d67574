"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import bpe, chat, exact_dedup, licenses, packing, perplexity, quality_rules, secrets, simhash, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_perplexity": perplexity.op2,
    "op3_license_scans": licenses.op3,
    "op4_chat_formatting": chat.op4,
    "op5_secret_scans": secrets.op5,
    "op6_simhash_near_dedup": simhash.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_bpe": bpe.op10,
}

SQL = {
    "op3_license_scans": licenses.OP3_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
