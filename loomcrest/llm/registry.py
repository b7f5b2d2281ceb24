"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontaminate, dominance, dual_tree, gam, lm_score, minhash, mixing, oracles, quality_rules, secrets, suffix_dedup, token_output, toxicity


def base_quality(spark, sf_dir: str):
    """The base columns of op2_quality_rules, without its fit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats, s = quality_rules.with_stats(docs)
    return stats.select("doc_id", *(f"{s}.{c}" for c in quality_rules.COUNTS[:5]), quality_rules.base_failed(s).alias("base_failed"))


def base_secrets(spark, sf_dir: str):
    """The base counts of op10_secrets."""
    return secrets.op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_token_output": token_output.op3_token_output,
        "op4_mixing": mixing.op4_mixing,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_minhash": minhash.op7_minhash,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_secrets": secrets.op10_secrets,
        "op11_clusters": dual_tree.op11_clusters,
        "op12_quality": gam.op12_quality,
        "op13_dominance": dominance.op13_dominance,
        "base_quality": base_quality,
        "base_secrets": base_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_suffix_dedup": oracles.SUFFIX_DEDUP, "op6_chat_format": oracles.CHAT_FORMAT, "op7_minhash": oracles.MINHASH, "op11_clusters": oracles.CLUSTERS, "op13_dominance": oracles.DOMINANCE, "base_quality": oracles.BASE_QUALITY, "base_secrets": oracles.BASE_SECRETS}
