"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, media, mixing, ngram, pii, quality, suffixes, toxicity
from .common import table


def op1_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_events(spark, sf_dir):
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op3_soft_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxic_kernel(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_media_sequences(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "documents"))


def op6_pii_bootstrap(spark, sf_dir):
    return pii.pii(table(spark, sf_dir, "documents"))


def op7_suffix_induced(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op8_bm25_wand(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bloom_lm(spark, sf_dir):
    return ngram.lm_scores(table(spark, sf_dir, "documents"))


def op10_jaccard_tree(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_chat_events, op3_soft_mixing, op4_toxic_kernel, op5_media_sequences, op6_pii_bootstrap, op7_suffix_induced, op8_bm25_wand, op9_bloom_lm, op10_jaccard_tree)}
ORACLES = {"op2_chat_events": chat.ORACLE}
