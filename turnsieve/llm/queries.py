"""Queries of the text problems: name -> function of (spark, sf_dir); SQL where DuckDB can say it."""

from __future__ import annotations

from ..runtime import table
from . import cuts, lookalike, packing, pairs, personal, tokens


def _t(spark, d, *names):
    return [table(spark, d, n) for n in names]


def p1_found(spark, d):
    return pairs.broken_pairs(*_t(spark, d, "reused_raw_answers", "probes"))


def p1_defect_report(spark, d):
    return pairs.defect_report(*_t(spark, d, "reused_raw_answers", "probes"))


def p2_token_budget(spark, d):
    return tokens.token_budget(*_t(spark, d, "probes", "datasets", "reused_raw_answers", "documents"))


def p2_prompt_tokens(spark, d):
    return tokens.text_tokens(tokens.prompt_texts(*_t(spark, d, "probes", "datasets")))


def p2_document_tokens(spark, d):
    return tokens.text_tokens(tokens.document_texts(table(spark, d, "documents")))


def p3_found(spark, d):
    return lookalike.substituted_fields(*_t(spark, d, "probes", "slot_values", "update_labels"))


def p3_consistent_values(spark, d):
    return lookalike.consistent_values(*_t(spark, d, "probes", "slot_values", "update_labels"))


def p4_found(spark, d):
    return cuts.truncated_records(*_t(spark, d, "probes", "turns", "reused_raw_answers"))


def p4_truncation_share(spark, d):
    return cuts.truncation_share(*_t(spark, d, "probes", "turns", "reused_raw_answers"))


def p6_ids(spark, d):
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_containers(spark, d):
    return packing.pack(*_t(spark, d, "documents", "pack_targets"))


def p7_fill_report(spark, d):
    return packing.fill_report(p7_containers(spark, d), table(spark, d, "pack_targets"))


def p8_found(spark, d):
    return personal.personal_mentions(table(spark, d, "documents"))


def p8_redacted(spark, d):
    return personal.redacted(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_defect_report, p2_token_budget, p2_prompt_tokens, p2_document_tokens, p3_found, p3_consistent_values, p4_found, p4_truncation_share, p6_ids, p7_containers, p7_fill_report, p8_found, p8_redacted)}

ORACLE: dict[str, str] = {}
