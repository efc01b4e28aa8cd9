"""Queries of the training-data operators and their SQL, for the driver's registry."""

from __future__ import annotations

from . import bpe, divergence, fingerprints, lines, media, near_dedup, packing, pipeline, quality, secrets, substring_dedup, toxicity, transducer, whitening


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
        "op3_quality": quality.op3_quality,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_i_match": fingerprints.op8_i_match,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_media_columns": media.op10_media_columns,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_whitening": whitening.op12_whitening,
        "op13_streaming_bpe": transducer.op13_streaming_bpe,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op4_near_dedup": near_dedup.OP4_SQL,
        "op5_substring_dedup": substring_dedup.OP5_SQL,
        "op7_secret_scan": secrets.OP7_SQL,
        "op9_line_dedup": lines.OP9_SQL,
        "op11_source_divergence": divergence.OP11_SQL,
    }
    return found | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
