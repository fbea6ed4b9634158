"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, earlier_copies, fingerprints, mixing, packing, parsing, quality, resampling, spellings, superkmers, token_files, url_rules, vectors

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_url_rules": url_rules.op2_url_rules,
    "op3_quality": quality.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_simhash": fingerprints.op5_simhash,
    "op6_substring_dedup": superkmers.op6_substring_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_vectors": vectors.op8_vectors,
    "op9_suffix_dedup": earlier_copies.op9_suffix_dedup,
    "op10_parsing": parsing.op10_parsing,
    "op11_resampling": resampling.op11_resampling,
    "op12_spellings": spellings.op12_spellings,
    "op13_bpe": bpe.op13_bpe,
}

ORACLE_SQL = {"op2_url_rules": url_rules.OP2_SQL, "op6_substring_dedup": superkmers.OP6_SQL, "op8_vectors": vectors.OP8_SQL, "op9_suffix_dedup": earlier_copies.OP9_SQL, "op11_resampling": resampling.OP11_SQL, "op12_spellings": spellings.OP12_SQL}
