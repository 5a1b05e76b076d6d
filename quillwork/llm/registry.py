"""Queries of the training-data operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .decontamination import op4_decontamination
from .gif import op9_gif_media
from .licences import op5_licence_digests, oracle
from .minhash import op13_minhash
from .packing import op3_packing
from .pii import op1_pii_feistel
from .quality import op8_quality_gam
from .secrets import op10_secrets
from .simhash import op7_simhash
from .substrings import op2_substring_dedup
from .turns import op11_turn_repair
from .turns import oracle as oracle_op11
from .warc import ORACLE_OP6, op6_warc
from .whitening import op12_whitening

QUERIES = {
    "op1_pii_feistel": op1_pii_feistel,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_licence_digests": op5_licence_digests,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_quality_gam": op8_quality_gam,
    "op9_gif_media": op9_gif_media,
    "op10_secrets": op10_secrets,
    "op11_turn_repair": op11_turn_repair,
    "op12_whitening": op12_whitening,
    "op13_minhash": op13_minhash,
}

ORACLE: dict[str, str] = {"op5_licence_digests": oracle(), "op6_warc": ORACLE_OP6, "op11_turn_repair": oracle_op11()}
