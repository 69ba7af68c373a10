"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from waymark.llm import clusters, decontaminate, langid, minhash, periods, pieces, pseudonyms, quality, quotes, tokencount, toxicity, vectors, warczip


def queries() -> dict:
    return {
        "op1_quotes": quotes.op1_quotes,
        "op2_minhash": minhash.op2_minhash,
        "op3_embeddings": vectors.op3_embeddings,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_pii": pseudonyms.op6_pii,
        "op7_warc": warczip.op7_warc,
        "op8_token_counts": tokencount.op8_token_counts,
        "op9_language_id": langid.op9_language_id,
        "op10_decontamination": decontaminate.op10_decontamination,
        "op11_quality": quality.op11_quality,
        "op12_centroids": clusters.op12_centroids,
        "op13_periods": periods.op13_periods,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quotes": quotes.ORACLE, "op2_minhash": minhash.ORACLE, "op3_embeddings": vectors.ORACLE, "op7_warc": warczip.ORACLE, "op9_language_id": langid.ORACLE, "op10_decontamination": decontaminate.ORACLE, "op12_centroids": clusters.ORACLE, "op13_periods": periods.ORACLE}
