"""The queries of this subpackage by name, and their SQL for DuckDB."""

from __future__ import annotations

from . import language, packing, pii, quality, sentence_pieces, sharding, simhash, suffixes, vectors, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_language": language.op2_language,
        "op3_sharding": sharding.op3_sharding,
        "op4_vectors": vectors.op4_vectors,
        "op5_suffixes": suffixes.op5_suffixes,
        "op6_sentencepiece": sentence_pieces.op6_sentencepiece,
        "op7_pii": pii.op7_pii,
        "op8_packing": packing.op8_packing,
        "op9_warc": warc.op9_warc,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_vectors": vectors.OP4_SQL, "op5_suffixes": suffixes.OP5_SQL, "op9_warc": warc.OP9_SQL}
