"""The queries of this subpackage, and the SQL that must give the same rows."""

from __future__ import annotations

from cardwright.llm import decontamination, fingerprints, jaccard, language, packing, pii, repeats, secrets, urls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_urls": urls.op2_urls,
    "op3_pii": pii.op3_pii,
    "op4_repeats": repeats.op4_repeats,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_secrets": secrets.op6_secrets,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_language": language.op9_language,
    "op10_packing": packing.op10_packing,
}
ORACLES = {"op1_warc": warc.ORACLE, "op2_urls": urls.ORACLE, "op4_repeats": repeats.ORACLE, "op5_jaccard": jaccard.ORACLE}
