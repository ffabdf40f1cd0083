"""The corpus queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tidemark.llm import ann, bpe, chat, exact_dedup, langid, minhash, packing, pii, substring_dedup, toxicity


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_pii": pii.query,
        "op2_nearest_neighbours": ann.query,
        "op3_best_fit_packing": packing.query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_toxicity": toxicity.query,
        "op6_bpe": bpe.query,
        "op7_near_dedup": minhash.query,
        "op8_language_id": langid.query,
        "op9_substring_dedup": substring_dedup.query,
        "op10_chat_format": chat.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.SQL, "op10_chat_format": chat.SQL}
