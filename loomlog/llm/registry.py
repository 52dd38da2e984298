"""Queries of the corpus operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from .alignment import op13_token_alignment
from .brown_lm import op9_brown_lm
from .decontaminate import op3_benchmark_decontamination
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .langid import op7_language_id
from .merkle import OP11_SQL, op11_merkle_manifest
from .mixing import OP5_SQL, op5_fair_queue_mix
from .packing import op12_packing
from .pii import op2_pii_sanitisation
from .secrets_crf import op4_secret_scan
from .simhash import op1_simhash_near_dedup
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .warc import op6_warc_round_trip

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_pii_sanitisation": op2_pii_sanitisation,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_secret_scan": op4_secret_scan,
    "op5_fair_queue_mix": op5_fair_queue_mix,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_brown_lm": op9_brown_lm,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_packing": op12_packing,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL = {
    "op5_fair_queue_mix": OP5_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
