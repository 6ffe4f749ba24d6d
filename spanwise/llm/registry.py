"""The queries of this subpackage and, where SQL can express them, the SQL that must give the same rows."""

from __future__ import annotations

from spanwise.llm import chat, licences, neardup, packing, pieces, pii, quality, search, toxicity, warc

QUERIES = {
    "op1_sentencepiece_nbest": pieces.query,
    "op2_pii_skipchain": pii.query,
    "op3_toxicity_fm": toxicity.query,
    "op4_hyperminhash": neardup.query,
    "op5_best_fit_swap": packing.query,
    "op6_licence_sentences": licences.query,
    "op7_warc_index": warc.query,
    "op8_cover_tree": search.query,
    "op9_quality_hosts": quality.query,
    "op10_chat_format": chat.query,
}

#: The others are a model's, a packing's or a lattice's results; tests hold those against brute force.
ORACLE_SQL = {
    "op4_hyperminhash": neardup.ORACLE,
    "op6_licence_sentences": licences.ORACLE,
    "op7_warc_index": warc.ORACLE,
    "op8_cover_tree": search.ORACLE,
    "op9_quality_hosts": quality.ORACLE,
    "op10_chat_format": chat.ORACLE,
}
