"""Registry of the corpus queries and of the SQL that checks them."""

from __future__ import annotations

from . import decontam, divergence, infill, jaccard, langid, lm, mixing, packing, pii, quality, sharding, toxicity, urls

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_pii": pii.op2_pii,
    "op3_urls": urls.op3_urls,
    "op4_sharding": sharding.op4_sharding,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_quality": quality.op6_quality,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_packing": packing.op8_packing,
    "op9_langid": langid.op9_langid,
    "op10_lm": lm.op10_lm,
    "op11_divergence": divergence.op11_divergence,
    "op12_mixing": mixing.op12_mixing,
    "op13_infill": infill.op13_infill,
}

ORACLE_SQL = {
    "op3_urls": urls.OP3_SQL,
    "op6_quality": quality.OP6_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op13_infill": infill.OP13_SQL,
}
