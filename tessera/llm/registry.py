"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from . import bpe, fingerprints, mixing, neighbours, parity_join, pii, repeats, secrets, toxicity, wrappers

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_personal_data": pii.op2_personal_data,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_parity_join": parity_join.op4_parity_join,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_secrets": secrets.op6_secrets,
    "op7_wrappers": wrappers.op7_wrappers,
    "op8_mixing": mixing.op8_mixing,
    "op9_bpe_codec": bpe.op9_bpe_codec,
    "op10_repeats": repeats.op10_repeats,
}

#: DuckDB SQL of the queries that SQL can express on whole tables.
SQL: dict[str, str] = {
    "op3_neighbours": neighbours.SQL,
    "op4_parity_join": parity_join.SQL,
    "op8_mixing": mixing.SQL,
}
