"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from auditloom.llm import bytecnn, collocations, langid, merkle, ordinal, packing, pieces, pivots, secrets, simhash_ball, slackbins, warc, weakrules

QUERIES = {
    "op1_ordinal_toxicity": ordinal.query,
    "op2_language": langid.query,
    "op3_byte_cnn": bytecnn.query,
    "op4_pivot_index": pivots.query,
    "op5_simhash_ball": simhash_ball.query,
    "op6_piece_codec": pieces.query,
    "op7_secret_links": secrets.query,
    "op8_tier_packing": packing.query,
    "op9_weak_rules": weakrules.query,
    "op10_warc": warc.query,
    "op11_merkle_intervals": merkle.query,
    "op12_slack_bins": slackbins.query,
    "op13_collocations": collocations.query,
}
SQL = {"op4_pivot_index": pivots.SQL, "op7_secret_links": secrets.SQL, "op9_weak_rules": weakrules.SQL, "op10_warc": warc.SQL,
       "op11_merkle_intervals": merkle.SQL, "op13_collocations": collocations.SQL}
