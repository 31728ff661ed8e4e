"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from lodestack.llm import decontaminate, embed_dedup, html_text, licenses, line_dedup, ngram_join, packing, perplexity, ranked_search, sharding, token_store, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_sharding": sharding.op3_sharding,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_token_store": token_store.op5_token_store,
        "op6_perplexity": perplexity.op6_perplexity,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_embedding_dedup": embed_dedup.op8_embedding_dedup,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_packing": packing.op10_packing,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_ranked_search": ranked_search.op12_ranked_search,
        "op13_html_text": html_text.op13_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.ORACLE,
        "op7_ngram_join": ngram_join.ORACLE,
        "op8_embedding_dedup": embed_dedup.ORACLE,
        "op11_vector_codes": vector_codes.ORACLE,
        "op12_ranked_search": ranked_search.ORACLE,
    }
