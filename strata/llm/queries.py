"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from . import op1_mixing, op2_quality, op3_language, op4_topk, op5_packing, op6_fingerprints, op7_licenses, op8_warc, op9_jaccard, op10_toxicity

QUERIES = {
    "op1_mixing": op1_mixing.query,
    "op2_quality": op2_quality.query,
    "op3_language": op3_language.query,
    "op4_topk": op4_topk.query,
    "op5_packing": op5_packing.query,
    "op6_fingerprints": op6_fingerprints.query,
    "op7_licenses": op7_licenses.query,
    "op8_warc": op8_warc.query,
    "op9_jaccard": op9_jaccard.query,
    "op10_toxicity": op10_toxicity.query,
}
ORACLES = {
    "op1_mixing": op1_mixing.ORACLE,
    "op4_topk": op4_topk.ORACLE,
    "op7_licenses": op7_licenses.ORACLE,
    "op8_warc": op8_warc.ORACLE,
    "op9_jaccard": op9_jaccard.ORACLE,
}
