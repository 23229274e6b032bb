"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from . import decontaminate, fingerprint, langid, linededup, mixing, neardup, quality, secrets, sharding, toxicity

QUERIES = {
    "op1_neardup": neardup.query,
    "op2_toxicity": toxicity.query,
    "op3_fingerprint": fingerprint.query,
    "op3_near_classes": fingerprint.classes_query,
    "op4_decontaminate": decontaminate.query,
    "op5_quality": quality.query,
    "op6_mixing": mixing.query,
    "op7_sharding": sharding.query,
    "op8_langid": langid.query,
    "op9_secrets": secrets.query,
    "op10_linededup": linededup.query,
}

ORACLES = {
    "op1_neardup": neardup.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "op10_linededup": linededup.ORACLE,
}
