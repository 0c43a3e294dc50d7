"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontam, html, langid, license, lines, media, mix, neardup, repeats, shard

QUERIES = {
    "op1_sharding": shard.op1_sharding,
    "op2_mixing": mix.op2_mixing,
    "op3_license_scan": license.op3_license_scan,
    "op4_media_columns": media.op4_media_columns,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_language_id": langid.op6_language_id,
    "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_repeated_bytes": repeats.op10_repeated_bytes,
}

ORACLE_SQL = {
    "op2_mixing": mix.OP2_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op7_minhash_near_dedup": neardup.OP7_SQL,
}
