"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import decontaminate, fingerprints, language, ngramjoin, packing, pii, tokens, toxicity, urlfilter, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_ngram_join": ngramjoin.op2_ngram_join,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_language_id": language.op5_language_id,
    "op6_packing": packing.op6_packing,
    "op7_warc": warc.op7_warc,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_pii": pii.op10_pii,
}
ORACLES = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op2_ngram_join": ngramjoin.OP2_SQL,
    "op4_url_filter": urlfilter.OP4_SQL,
    "op7_warc": warc.OP7_SQL,
}
