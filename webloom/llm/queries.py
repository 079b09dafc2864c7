"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import centroids, classifier, fingerprints, jaccard, licenses, lines, mixing, neighbours, packing, sharding, substrings, tokenfile, whitening

QUERIES = {
    "op1_hypergeometric_shards": sharding.op1_hypergeometric_shards,
    "op2_directly_addressable": tokenfile.op2_directly_addressable,
    "op3_multi_order_jaccard": jaccard.op3_multi_order_jaccard,
    "op4_line_first_rules": lines.op4_line_first_rules,
    "op5_conditional_compression": licenses.op5_conditional_compression,
    "op6_canonical_digest": fingerprints.op6_canonical_digest,
    "op7_collinear_chaining": substrings.op7_collinear_chaining,
    "op8_bin_completion": packing.op8_bin_completion,
    "op9_pareto_mix": mixing.op9_pareto_mix,
    "op10_ftrl_quality": classifier.op10_ftrl_quality,
    "op11_lanczos_whitening": whitening.op11_lanczos_whitening,
    "op12_nn_descent": neighbours.op12_nn_descent,
    "op13_incremental_centroids": centroids.op13_incremental_centroids,
}

ORACLES = {
    "op3_multi_order_jaccard": jaccard.OP3_SQL,
    "op4_line_first_rules": lines.OP4_SQL,
    "op9_pareto_mix": mixing.OP9_SQL,
    "op12_nn_descent": neighbours.op12_nn_descent,
    "op13_incremental_centroids": centroids.OP13_SQL,
}
