"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import bitslice, decontaminate, licenses, mixing, ranked, sharding, warc
from .bitslice import op2_bit_slices
from .decontaminate import op11_decontaminate
from .licenses import op3_licenses
from .mixing import op9_mixing
from .packing import op6_packing
from .quality import op7_quality_rules
from .ranked import op13_ranked_search
from .sharding import op8_sharding
from .simhash import op10_simhash
from .token_files import op4_token_files
from .toxicity import op5_toxicity
from .warc import op1_warc
from .whitening import op12_whitening

QUERIES = {
    "op1_warc": op1_warc,
    "op2_bit_slices": op2_bit_slices,
    "op3_licenses": op3_licenses,
    "op4_token_files": op4_token_files,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_decontaminate": op11_decontaminate,
    "op12_whitening": op12_whitening,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op2_bit_slices": bitslice.SQL,
    "op3_licenses": licenses.SQL,
    "op8_sharding": sharding.SQL,
    "op9_mixing": mixing.SQL,
    "op11_decontaminate": decontaminate.SQL,
    "op13_ranked_search": ranked.SQL,
}
