"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quarry.llm import decontaminate, lang_id, licenses, line_dedup, near_dup, packing, periodic_runs, quality, resample, substring_dedup, token_counts, token_store, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_near_dedup": near_dup.op2_near_dedup,
    "op3_token_store": token_store.op3_token_store,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_language_id": lang_id.op5_language_id,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_importance_resampling": resample.op12_importance_resampling,
    "op13_license_scan": licenses.op13_license_scan,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op10_quality_rules": quality.OP10_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
