"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import partial

from . import chat, jaccard, kneser_ney, leaks, lines, mixing, neighbours, secrets, sharding, spelling, toxicity, urls, whitening

QUERIES = {
    "op1_histogram_sort_shards": sharding.op1,
    "op2_weighted_mix": mixing.op2,
    "op3_toxicity": toxicity.op3,
    "op4_kneser_ney": partial(kneser_ney.op4, additive=True),
    "op5_block_neighbours": neighbours.op5,
    "op6_prefix_target_chat": chat.op6,
    "op7_chosen_path_join": jaccard.op7,
    "op8_secret_scan": secrets.op8,
    "op9_benchmark_leaks": leaks.op9,
    "op10_url_filter": urls.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_lobpcg_whitening": whitening.op12,
    "op13_line_dedup": lines.op13,
}

ORACLES = {
    "op2_weighted_mix": mixing.OP2_SQL,
    "op5_block_neighbours": neighbours.OP5_SQL,
    "op6_prefix_target_chat": chat.OP6_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op13_line_dedup": lines.OP13_SQL,
}
