"""The queries of the operators and the pipeline, with their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline

from veritext.llm import decontamination, exact_dedup, jaccard_join, lm_scoring, pii, quality_classifier, secret_scan, sentencepiece_bpe, substring_dedup, warc_bundles


def queries() -> dict:
    return {
        "op1_lm_scoring": lm_scoring.query,
        "op2_secret_scan": secret_scan.query,
        "op3_warc_bundles": warc_bundles.query,
        "op4_quality_classifier": quality_classifier.query,
        "op5_sentencepiece": sentencepiece_bpe.query,
        "op6_jaccard_join": jaccard_join.query,
        "jaccard_links": jaccard_join.query_links,
        "op7_exact_dedup": exact_dedup.query,
        "op8_pii": pii.query,
        "op9_decontamination": decontamination.query,
        "op10_substring_dedup": substring_dedup.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_lm_scoring": lm_scoring.ORACLE,
        "op3_warc_bundles": warc_bundles.ORACLE,
        "op6_jaccard_join": jaccard_join.LINKS_ORACLE,
        "jaccard_links": jaccard_join.LINKS_ORACLE,
        "op7_exact_dedup": exact_dedup.ORACLE,
        "op9_decontamination": decontamination.ORACLE,
        "op10_substring_dedup": substring_dedup.ORACLE,
    }
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
