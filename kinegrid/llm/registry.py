"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, byte_bpe, chat, minhash_dedup, quality_forest, sentencepiece, source_mix, suffix_dedup, token_align, toxicity, turn_repair, url_filter, warc

QUERIES = {
    "op1_cross_polytope": ann.op1_cross_polytope,
    "op2_warc": warc.op2_warc,
    "op3_chat_masks": chat.op3_chat_masks,
    "op4_sentencepiece": sentencepiece.op4_sentencepiece,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_minhash_dedup": minhash_dedup.op9_minhash_dedup,
    "op10_quality_forest": quality_forest.op10_quality_forest,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_token_align": token_align.op12_token_align,
    "op13_turn_repair": turn_repair.op13_turn_repair,
}

ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op3_chat_masks": chat.OP3_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op6_source_mix": source_mix.OP6_SQL,
    "op13_turn_repair": turn_repair.OP13_SQL,
}
