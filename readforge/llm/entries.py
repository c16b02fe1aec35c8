"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, langid, media, mixing, quality, sharding, simhash, suffix, warc


def queries():
    return {
        "op1_pigeonhole_decontamination": decontaminate.op1_pigeonhole_decontamination,
        "op2_zstd_dictionary_langid": langid.op2_zstd_dictionary_langid,
        "op3_gam_pairs_quality": quality.op3_gam_pairs_quality,
        "op4_simhash_pigeonring": simhash.op4_simhash_pigeonring,
        "op5_media_archives": media.op5_media_archives,
        "op6_prefix_free_dedup": suffix.op6_prefix_free_dedup,
        "op7_warc_normaliser": warc.op7_warc_normaliser,
        "op8_pareto_mixing": mixing.op8_pareto_mixing,
        "op9_label_propagation_sharding": sharding.op9_label_propagation_sharding,
        "op10_reply_tree_chat": chat.op10_reply_tree_chat,
    }


def oracle_sql():
    return {"op7_warc_normaliser": warc.OP7_SQL, "op8_pareto_mixing": mixing.OP8_SQL, "op10_reply_tree_chat": chat.OP10_SQL}
