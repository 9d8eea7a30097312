"""The registered queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from . import bpe, fingerprint, langid, media, neardup, packing, pii, quality, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_warc": warc.op2_warc,
    "op3_pii": pii.op3_pii,
    "op4_media": media.op4_media,
    "op5_quality": quality.op5_quality,
    "op6_langid": langid.op6_langid,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_packing": packing.op8_packing,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_neardup": neardup.op10_neardup,
}

ORACLE_SQL = {"op2_warc": warc.ORACLE}
