"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from . import decontamination, filter_audit, fingerprints, pii, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup, token_files, toxicity, vector_codes, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
        "op3_warc": warc.op3_warc,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_simhash": simhash.op5_simhash,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_pii": pii.op7_pii,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_token_files": token_files.op10_token_files,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_fingerprints": fingerprints.op12_fingerprints,
        "op13_vector_codes": vector_codes.op13_vector_codes,
        "quality_rule_ablations": quality_rules.quality_rule_ablations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.OP1_SQL,
        "op3_warc": warc.OP3_SQL,
        "op9_quality_rules": quality_rules.OP9_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op13_vector_codes": vector_codes.OP13_SQL,
        "quality_rule_ablations": quality_rules.ABLATIONS_SQL,
    }
