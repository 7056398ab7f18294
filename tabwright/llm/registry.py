"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tabwright.llm import audit, bpe, chat, decontaminate, exact, licenses, lines, merkle, near, quality, secrets, sharding, token_counts


def op3_line_dedup(spark, sf_dir):
    return lines.op3_line_dedup(spark, sf_dir, lines.BANDS)


QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_bpe_roundtrip": bpe.op2_bpe_roundtrip,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_quality": quality.op5_quality,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_minhash_near_dedup": near.op7_minhash_near_dedup,
    "op8_chat_format": chat.op8_chat_format,
    "op9_sharding": sharding.op9_sharding,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_license_scan": licenses.op13_license_scan,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact.OP4_SQL,
    "op7_minhash_near_dedup": near.OP7_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_license_scan": licenses.OP13_SQL,
}
