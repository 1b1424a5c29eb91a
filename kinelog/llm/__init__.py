"""Operators that prepare text corpora for training, and the queries that apply them to the test tables."""

from __future__ import annotations

from . import decontamination, jaccard, language, lempel_ziv, licences, periods, personal, quality, search, sentencepieces, sharding, suffixes, urls

_QUERIES = {
    "op1_flow_reshard": sharding.op1_flow_reshard,
    "op2_sparse_suffixes": suffixes.op2_sparse_suffixes,
    "op3_chosen_path_join": jaccard.op3_chosen_path_join,
    "op4_redirect_equivalence": urls.op4_redirect_equivalence,
    "op5_string_tiling": decontamination.op5_string_tiling,
    "op6_sentence_pieces": sentencepieces.op6_sentence_pieces,
    "op7_logistic_language": language.op7_logistic_language,
    "op8_line_quality": quality.op8_line_quality,
    "op9_relative_lempel_ziv": lempel_ziv.op9_relative_lempel_ziv,
    "op10_random_field": personal.op10_random_field,
    "op11_suffix_automaton": periods.op11_suffix_automaton,
    "op12_rare_word_index": licences.op12_rare_word_index,
    "op13_block_max_search": search.op13_block_max_search,
}
_ORACLES = {
    "op4_redirect_equivalence": urls.ORACLE,
    "op8_line_quality": quality.QUERY_SQL,
    "op12_rare_word_index": licences.ORACLE,
    "op13_block_max_search": search.ORACLE,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
