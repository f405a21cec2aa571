"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from lectern.llm import decontam, exact_dedup, fill_middle, html_extract, language_id, mixing, near_dedup, neighbours, pii, prefix_trie, quality, substring_dedup, url_filter


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_language_id": language_id.op2_language_id,
        "op3_mixing": mixing.op3_mixing,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_html_extract": html_extract.op5_html_extract,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_quality": quality.op7_quality,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_pii": pii.op10_pii,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_fill_middle": fill_middle.op12_fill_middle,
        "op13_neighbours": neighbours.op13_neighbours,
        "pii_base": pii.pii_base,
        "url_listed": url_filter.url_listed,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict:
    return {
        "op1_decontamination": decontam.OP1_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op4_substring_dedup": substring_dedup.OP4_SQL,
        "op6_near_dedup": near_dedup.OP6_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_fill_middle": fill_middle.OP12_SQL,
        "op13_neighbours": neighbours.OP13_SQL,
        "pii_base": pii.PII_BASE_SQL,
        "url_listed": url_filter.URL_LISTED_SQL,
    }
