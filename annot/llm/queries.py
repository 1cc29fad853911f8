"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline

from . import brown_lm, chosen_path, collocations, exact_dedup, mixing, packing, periodic_runs, pii, quality, repetition_rules, suffix_dedup, toxicity, weighted_sampling


def queries() -> dict:
    return {
        "op1_quality_scores": quality.op1_quality_scores,
        "op2_near_duplicates": chosen_path.op2_near_duplicates,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_pack_sequences": packing.op4_pack_sequences,
        "op5_class_lm_scores": brown_lm.op5_class_lm_scores,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_remove_repeats": suffix_dedup.op7_remove_repeats,
        "op8_weighted_fingerprints": weighted_sampling.op8_weighted_fingerprints,
        "op9_toxicity_scores": toxicity.op9_toxicity_scores,
        "op10_personal_data": pii.op10_personal_data,
        "op11_phrase_collocations": collocations.op11_phrase_collocations,
        "op12_quality_rules": repetition_rules.op12_quality_rules,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op11_phrase_collocations": collocations.ORACLE}
