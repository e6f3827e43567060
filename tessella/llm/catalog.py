"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from tessella.llm import decontaminate, exact_dedup, language_id, line_dedup, pii_surrogates, quality_rules, sentencepieces, sharding, simhash, spelling, token_alignment, token_store, url_filter


def queries():
    import corpus_pipeline  # at the repository's top, beside the entry points

    return {
        "pipeline": corpus_pipeline.run,
        "op1_language_id": language_id.op1_language_id,
        "op2_token_store": token_store.op2_token_store,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_simhash": simhash.op4_simhash,
        "op5_quality": quality_rules.op5_quality,
        "op6_sentencepiece": sentencepieces.op6_sentencepiece,
        "op7_pii_surrogates": pii_surrogates.op7_pii_surrogates,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_sharding": sharding.op10_sharding,
        "op11_url_filter": url_filter.op11_url_filter,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql():
    import corpus_pipeline

    out = {"op8_exact_dedup": exact_dedup.OP8_SQL, "op11_url_filter": url_filter.OP11_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in out.items() if sql}
