"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bucket_pair, exact_dedup, importance_resampling, jaccard_join, lm_scoring, mixing, projected_neighbours, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, token_counts, warc_fixity

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.encode_query,
    "op2_warc_fixity": warc_fixity.fixity_query,
    "op3_exact_dedup": exact_dedup.dedup_query,
    "op4_quality_classifier": quality_classifier.classifier_query,
    "op5_substring_dedup": substring_dedup.repeats_query,
    "op6_quality_rules": quality_rules.rules_query,
    "op7_token_counts": token_counts.counts_query,
    "op8_mixing": mixing.mix_query,
    "op9_lm_scoring": lm_scoring.lm_query,
    "op10_jaccard_join": jaccard_join.join_query,
    "op11_projected_neighbours": projected_neighbours.nearest_query,
    "op12_bucket_pair": bucket_pair.pair_query,
    "op13_importance_resampling": importance_resampling.resample_query,
}

ORACLES = {
    "op2_warc_fixity": warc_fixity.FIXITY_SQL,
    "op3_exact_dedup": exact_dedup.DEDUP_SQL,
    "op6_quality_rules": quality_rules.RULES_SQL,
    "op8_mixing": mixing.MIX_SQL,
    "op13_importance_resampling": importance_resampling.RESAMPLE_SQL,
}
