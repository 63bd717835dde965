"""The operators' registered queries and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontamination, jaccard_join, language, packing, pii, quality_classifier, quality_rules, sharding, token_files, toxicity

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_language": language.query,
    "op3_pii": pii.query,
    "op4_toxicity": toxicity.query,
    "op5_quality_rules": quality_rules.query,
    "op6_jaccard_join": jaccard_join.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_decontamination": decontamination.query,
    "op9_packing": packing.query,
    "op10_sharding": sharding.query,
}
ORACLES = {"op8_decontamination": decontamination.SQL}
