"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import caps, langid, lloyd, mixing, pii, quality, quotes, repair, secrets, simhash, suffixes, tiling, tokens

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_quotes": quotes.op2_quotes,
    "op3_repeats": suffixes.op3_repeats,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality": quality.op5_quality,
    "op6_contamination": tiling.op6_contamination,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_language": langid.op8_language,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_spherical_caps": caps.op10_spherical_caps,
    "op11_context_pii": pii.op11_context_pii,
    "op12_delta_lloyd": lloyd.op12_delta_lloyd,
    "op13_conversation_repair": repair.op13_conversation_repair,
}
ORACLE_SQL = {"op9_source_mix": mixing.OP9_SQL, "op12_delta_lloyd": lloyd.OP12_SQL, "op13_conversation_repair": repair.OP13_SQL}
