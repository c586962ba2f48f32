"""The training-data queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bagminhash, chat, hnsw, mixing, packing, quality, secrets, sharding, tokenstore, vectordups

QUERIES = {
    "op1_pack": packing.op1_pack,
    "op2_ann": hnsw.op2_ann,
    "op3_quality": quality.op3_quality,
    "op4_secrets": secrets.op4_secrets,
    "op5_shard": sharding.op5_shard,
    "op6_near_dups": bagminhash.op6_near_dups,
    "op7_token_store": tokenstore.op7_token_store,
    "op8_chat": chat.op8_chat,
    "op9_vector_dups": vectordups.op9_vector_dups,
    "op10_mix": mixing.op10_mix,
}

ORACLES = {
    "op4_secrets": secrets.ORACLE,
    "op8_chat": chat.ORACLE,
    "op9_vector_dups": vectordups.ORACLE,
    "op10_mix": mixing.ORACLE,
}
