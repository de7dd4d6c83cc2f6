"""The queries of this package and their SQL equivalents."""

from __future__ import annotations

from cinderlog.llm import bpe, decontaminate, langid, licenses, passages, quality, secrets, sharding, simhash, urlfilter


def queries() -> dict:
    return {
        "op1_blob_ledger": secrets.op1_blob_ledger,
        "op2_feistel_shards": sharding.op2_feistel_shards,
        "op3_url_rules": urlfilter.op3_url_rules,
        "op4_output_codes": langid.op4_output_codes,
        "op5_ngram_hash_set": decontaminate.op5_ngram_hash_set,
        "op6_phrase_automata": passages.op6_phrase_automata,
        "op7_line_frequency": quality.op7_line_frequency,
        "op8_segment_tree_bpe": bpe.op8_segment_tree_bpe,
        "op9_deletion_variants": simhash.op9_deletion_variants,
        "op10_licence_paragraphs": licenses.op10_licence_paragraphs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_blob_ledger": secrets.ORACLE_SQL, "op3_url_rules": urlfilter.ORACLE_SQL, "op5_ngram_hash_set": decontaminate.ORACLE_SQL, "op6_phrase_automata": passages.ORACLE_SQL, "op7_line_frequency": quality.ORACLE_SQL}
