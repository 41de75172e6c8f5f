"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language_id, media, mixing, repeats, secrets, similarity, token_counts, toxicity, url_reputation

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_url_reputation": url_reputation.op3_url_reputation,
    "op4_suffix_array_dedup": repeats.op4_suffix_array_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_jaccard_join": similarity.op6_jaccard_join,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_media_columns": media.op8_media_columns,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_language_id": language_id.op10_language_id,
}
SQL = {"op3_url_reputation": url_reputation.SQL, "op6_jaccard_join": similarity.SQL, "op9_benchmark_decontamination": decontaminate.SQL}
