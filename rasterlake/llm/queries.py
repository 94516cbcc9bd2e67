"""Queries of this subpackage, and their SQL where SQL can express them."""

from . import centroids, class_lm, decontamination, fingerprints, hard_negatives, html_text, jaccard_join, line_dedup, packing, sharding, simhash, toxicity, url_lists

QUERIES = {
    "op1_hilbert_shards": sharding.op1_hilbert_shards,
    "op2_winnowing": decontamination.op2_winnowing,
    "op3_temporal_lists": url_lists.op3_temporal_lists,
    "op4_class_lm": class_lm.op4_class_lm,
    "op5_closed_syncmers": fingerprints.op5_closed_syncmers,
    "op6_line_runs": line_dedup.op6_line_runs,
    "op7_block_lstm": html_text.op7_block_lstm,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_chosen_path": jaccard_join.op10_chosen_path,
    "op11_annulus_search": centroids.op11_annulus_search,
    "op12_norm_buckets": hard_negatives.op12_norm_buckets,
    "op13_segment_popcounts": simhash.op13_segment_popcounts,
}

SQL = {
    "op2_winnowing": decontamination.OP2_SQL,
    "op3_temporal_lists": url_lists.OP3_SQL,
    "op6_line_runs": line_dedup.OP6_SQL,
    "op10_chosen_path": jaccard_join.OP10_SQL,
    "op11_annulus_search": centroids.OP11_SQL,
    "op12_norm_buckets": hard_negatives.OP12_SQL,
}
