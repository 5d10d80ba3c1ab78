"""Queries of this subpackage, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from pairmill.llm import alignment, bytebpe, fingerprint, licenses, mixing, neardup, neighbours, packing, pii, quality, records, tokencount, whitening


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprint.op1_fingerprints,
        "op2_quality": quality.op2_quality,
        "op3_token_counts": tokencount.op3_token_counts,
        "op4_records": records.op4_records,
        "op5_packing": packing.op5_packing,
        "op6_pii": pii.op6_pii,
        "op7_near_duplicates": neardup.op7_near_duplicates,
        "op8_licenses": licenses.op8_licenses,
        "op9_mixing": mixing.op9_mixing,
        "op10_neighbours": neighbours.op10_neighbours,
        "op11_byte_bpe": bytebpe.op11_byte_bpe,
        "op12_whitening": whitening.op12_whitening,
        "op13_alignment": alignment.op13_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op7_near_duplicates": neardup.ORACLE_SQL, "op8_licenses": licenses.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
