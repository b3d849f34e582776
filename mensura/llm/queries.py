"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, langid, lines, media, nearest, neardup, packing, pieces, pii, substring

QUERIES = {
    "op1_pieces": pieces.query,
    "op2_language": langid.query,
    "op3_media": media.query,
    "op4_chat": chat.query,
    "op5_lines": lines.query,
    "op6_substring": substring.query,
    "op7_packing": packing.query,
    "op8_pii": pii.query,
    "op9_nearest": nearest.query,
    "op10_neardup": neardup.query,
}

ORACLES: dict[str, str] = {"op5_lines": lines.SQL, "op6_substring": substring.SQL, "op10_neardup": neardup.SQL}
