"""Queries of the training-data operators, and SQL for those that SQL can express."""

from . import decontaminate, merkle, neardup, packing, passages, pii, quality_crf, quality_rules, secret_scan, spelling, token_files, toxicity, warc

QUERIES = {
    "op1_crf_quality": quality_crf.query,
    "op2_setsketch_neardup": neardup.query,
    "op3_orc_tokens": token_files.query,
    "op4_grammar_secrets": secret_scan.query,
    "op5_cnn_toxicity": toxicity.query,
    "op6_weak_pii": pii.query,
    "op7_warc_transactions": warc.query,
    "op8_bm25_decontaminate": decontaminate.query,
    "op9_bounded_packing": packing.query,
    "op10_forest_rules": quality_rules.query,
    "op11_suffix_passages": passages.query,
    "op12_qchunk_variants": spelling.query,
    "op13_butterfly_manifest": merkle.query,
}

ORACLES = {
    "op2_setsketch_neardup": neardup.ORACLE,
    "op7_warc_transactions": warc.ORACLE,
    "op11_suffix_passages": passages.ORACLE,
    "op12_qchunk_variants": spelling.ORACLE,
    "op13_butterfly_manifest": merkle.ORACLE,
}
