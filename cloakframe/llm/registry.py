"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from . import bpe, chat, exact_dedup, language, near_dedup, neighbours, packing, pii, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_warc_zip": warc.query,
    "op3_language_id": language.query,
    "op4_simhash_near_dedup": near_dedup.query,
    "op5_best_fit_packing": packing.query,
    "op6_bpe_encode_decode": bpe.query,
    "op7_pii_sanitisation": pii.query,
    "op8_chat_perspectives": chat.query,
    "op9_nearest_neighbours": neighbours.query,
    "op10_exact_dedup": exact_dedup.query,
}

ORACLES = {
    "op8_chat_perspectives": chat.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
