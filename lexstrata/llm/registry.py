"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, language_model, near_dup, packing, pii, sharding, suffix_dedup, toxicity, url_filter, vector_search


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_url_template_tree": url_filter.query,
        "op2_crf_toxicity": toxicity.query,
        "op3_order_minhash": near_dup.query,
        "op4_best_fit_packing": packing.query,
        "op5_katz_backoff": language_model.query,
        "op6_va_file_search": vector_search.query,
        "op7_validated_pii": pii.query,
        "op8_virtual_slots": sharding.query,
        "op9_suffix_arrays": suffix_dedup.query,
        "op10_spaced_seeds": decontamination.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {}
