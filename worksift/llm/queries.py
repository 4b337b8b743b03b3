"""Queries of this subpackage and, where SQL can express them, their equivalents."""

from worksift.llm import op1_minhash, op2_warc, op3_secrets, op4_decontaminate, op5_line_dedup, op6_quality, op7_toxicity, op8_chat, op9_packing, op10_sharding, op11_merkle, op12_retrieval_packing, op13_centroids

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash.op1_minhash_near_dedup,
        op2_warc.op2_warc_derivatives,
        op3_secrets.op3_secret_scan,
        op4_decontaminate.op4_benchmark_decontamination,
        op5_line_dedup.op5_line_dedup,
        op6_quality.op6_quality_rules,
        op7_toxicity.op7_toxicity,
        op8_chat.op8_chat_prefix_tree,
        op9_packing.op9_best_fit_packing,
        op10_sharding.op10_rendezvous_sharding,
        op11_merkle.op11_merkle_manifest,
        op12_retrieval_packing.op12_retrieval_packing,
        op13_centroids.op13_centroid_clustering,
    )
}

SQL = {
    "op1_minhash_near_dedup": op1_minhash.ORACLE,
    "op3_secret_scan": op3_secrets.ORACLE,
    "op4_benchmark_decontamination": op4_decontaminate.ORACLE,
    "op5_line_dedup": op5_line_dedup.ORACLE,
    "op11_merkle_manifest": op11_merkle.ORACLE,
    "op13_centroid_clustering": op13_centroids.ORACLE,
}
