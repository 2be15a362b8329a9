"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import asof_join, bpe, collocations, exact_dedup, lm_score, packing, pii, quality_classifier, quality_rules, simhash, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_pii": pii.op3_pii,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_lm_score": lm_score.op5_lm_score,
        "op6_bpe": bpe.op6_bpe,
        "op7_packing": packing.op7_packing,
        "op8_warc": warc.op8_warc,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_collocations": collocations.op11_collocations,
        "op12_asof_join": asof_join.op12_asof_join,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op4_url_filter": url_filter.OP4_SQL, "op8_warc": warc.OP8_SQL, "op11_collocations": collocations.OP11_SQL, "op12_asof_join": asof_join.OP12_SQL}
