"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import chat, collision_count, decontaminate, hyperminhash, language_mix, license_lookup, merkle, minimax_shards, neighbour_vote, packing, prefix_trie, suffix_index, warc


def queries() -> dict:
    return {
        "op1_warc_transactions": warc.op1_warc_transactions,
        "op2_chat_format": chat.op2_chat_format,
        "op3_hyperminhash": hyperminhash.op3_hyperminhash,
        "op4_neighbour_vote": neighbour_vote.op4_neighbour_vote,
        "op5_license_lookup": license_lookup.op5_license_lookup,
        "op6_language_mixture": language_mix.op6_language_mixture,
        "op7_suffix_index": suffix_index.op7_suffix_index,
        "op8_collision_count": collision_count.op8_collision_count,
        "op9_latent_decontamination": decontaminate.op9_latent_decontamination,
        "op10_mixture_packing": packing.op10_mixture_packing,
        "op11_minimax_shards": minimax_shards.op11_minimax_shards,
        "op12_sequence_collapse": prefix_trie.op12_sequence_collapse,
        "op13_merkle_descent": merkle.op13_merkle_descent,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_transactions": warc.OP1_SQL,
        "op2_chat_format": chat.OP2_SQL,
        "op3_hyperminhash": hyperminhash.OP3_SQL,
        "op5_license_lookup": license_lookup.OP5_SQL,
        "op7_suffix_index": suffix_index.OP7_SQL,
        "op8_collision_count": collision_count.OP8_SQL,
        "op11_minimax_shards": minimax_shards.OP11_SQL,
        "op12_sequence_collapse": prefix_trie.OP12_SQL,
        "op13_merkle_descent": merkle.OP13_SQL,
    }
