"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from cinderwell.llm import arrowfiles, digests, licenses, lm, mixing, pieces, quality, resample, rollup, runs, simhash, urls, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_fingerprints": digests.op2_fingerprints,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_token_ids": arrowfiles.op4_token_ids,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_url_filter": urls.op7_url_filter,
    "op8_token_rollup": rollup.op8_token_rollup,
    "op9_warc_derivatives": warc.op9_warc_derivatives,
    "op10_source_mix": mixing.op10_source_mix,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_lm_scoring": lm.op13_lm_scoring,
}

SQL = {
    "op3_quality_rules": quality.OP3_SQL,
    "op6_license_scan": licenses.OP6_SQL,
    "op7_url_filter": urls.OP7_SQL,
    "op11_importance_resampling": resample.OP11_SQL,
}
