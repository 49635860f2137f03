"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat, classifier, linedup, mixing, neardup, pieces, quality, sharding, substrings, vectors


def queries():
    return {
        "op1_quality_rules": quality.op1,
        "op2_suffix_dedup": substrings.op2,
        "op3_mixing": mixing.op3,
        "op4_chat_formatting": chat.op4,
        "op5_sentencepiece": pieces.op5,
        "op6_quality_classifier": classifier.op6,
        "op7_sharding": sharding.op7,
        "op8_minhash_neardup": neardup.op8,
        "op9_embedding_neardup": vectors.op9,
        "op10_line_dedup": linedup.op10,
    }


def oracle_sql():
    return {
        "op1_quality_rules": quality.SQL,
        "op3_mixing": mixing.SQL,
        "op4_chat_formatting": chat.SQL,
        "op8_minhash_neardup": neardup.SQL,
        "op9_embedding_neardup": vectors.SQL,
        "op10_line_dedup": linedup.SQL,
    }
