"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from erspark.llm import annsearch, bpe, chat, linededup, packing, quality, secrets, sharding, simhash, urlfilter

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_line_dedup": linededup.op2,
    "op3_url_filters": urlfilter.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_nearest_neighbours": annsearch.op5,
    "op6_secret_scans": secrets.op6,
    "op7_chat_formatting": chat.op7,
    "op8_bpe_round_trip": bpe.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_sharding": sharding.op10,
}
ORACLE_SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_line_dedup": linededup.OP2_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
}
