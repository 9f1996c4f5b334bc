"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, html, langid, mixing, neardup, packing, quality, records, suffixes, vectors

QUERIES = {
    "op1_quality": quality.query,
    "op2_mixing": mixing.query,
    "op3_neardup": neardup.query,
    "op4_vectors": vectors.query,
    "op5_records": records.query,
    "op6_packing": packing.query,
    "op7_suffixes": suffixes.query,
    "op8_chat": chat.query,
    "op9_langid": langid.query,
    "op10_html": html.query,
}

ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op4_vectors": vectors.ORACLE,
    "op8_chat": chat.ORACLE,
}
