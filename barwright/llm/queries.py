"""The registered queries of this subpackage and, where SQL can express them, their counterparts."""

from barwright.llm import chat, jaccard, lm, minhash, mixing, negatives, ordering, packing, private, quality, sharding, simhash, whitening

QUERIES = {
    "op1_lm_scores": lm.query,
    "op2_sharding": sharding.query,
    "op3_mixing": mixing.query,
    "op4_preferences": chat.query,
    "op5_training_order": ordering.query,
    "op6_private_data": private.query,
    "op7_fingerprints": minhash.query,
    "op8_quality_rules": quality.query,
    "op9_packing": packing.query,
    "op10_simhash": simhash.query,
    "op11_whitening": whitening.query,
    "op12_jaccard_join": jaccard.query,
    "op13_hard_negatives": negatives.query,
}

ORACLES = {"op4_preferences": chat.SQL, "op13_hard_negatives": negatives.SQL}
