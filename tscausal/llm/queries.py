"""The opN queries, each over its whole table with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, html, licenses, lm, mixing, quality, simhash, suffix, tokens, topk
from .common import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.op1_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix.op2_suffix_dedup(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return tokens.op3_token_counts(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.op4_mixing(table(spark, sf_dir, "documents"))


def op5_topk(spark, sf_dir):
    return topk.op5_topk(table(spark, sf_dir, "embeddings"))


def op6_quality(spark, sf_dir):
    return quality.op6_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark, sf_dir):
    return simhash.op7_simhash(table(spark, sf_dir, "documents"))


def op8_licenses(spark, sf_dir):
    return licenses.op8_licenses(table(spark, sf_dir, "documents"))


def op9_lm(spark, sf_dir):
    return lm.op9_lm(table(spark, sf_dir, "documents"))


def op10_html(spark, sf_dir):
    return html.op10_html(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_licenses": op8_licenses,
    "op9_lm": op9_lm,
    "op10_html": op10_html,
}

ORACLE_SQL: dict[str, str] = {
    "op5_topk": topk.OP5_SQL,
    "op8_licenses": licenses.op8_sql(),
}
