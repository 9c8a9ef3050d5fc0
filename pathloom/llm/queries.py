"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, fingerprints, jaccard_join, licenses, line_dedup, media, packing, secrets, toxicity


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_packing": packing.op2_packing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_bpe": bpe.op6_bpe,
        "op7_secrets": secrets.op7_secrets,
        "op8_licenses": licenses.op8_licenses,
        "op9_chat": chat.op9_chat,
        "op10_media": media.op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.OP1_SQL, "op2_packing": packing.OP2_SQL, "op4_jaccard_join": jaccard_join.OP4_SQL, "op5_fingerprints": fingerprints.OP5_SQL, "op8_licenses": licenses.OP8_SQL, "op9_chat": chat.OP9_SQL, "op10_media": media.OP10_SQL}
