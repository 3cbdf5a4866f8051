"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from tidewell.llm import alignment, conversations, decontamination, exact_dedup, langid, licenses, mixing, pii, sharding, simhash, token_counts, toxicity, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_pii": pii.op2_pii,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_langid": langid.op4_langid,
    "op5_simhash": simhash.op5_simhash,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_sharding": sharding.op10_sharding,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_license_scan": licenses.op12_license_scan,
    "op13_token_alignment": alignment.op13_token_alignment,
}

ORACLE_SQL = {
    "op6_warc": warc.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op11_conversation_repair": conversations.ORACLE_SQL,
    "op12_license_scan": licenses.ORACLE_SQL,
}
