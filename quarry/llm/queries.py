"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import OP4_SQL, op4_decontaminate
from .fingerprint import op5_fingerprint
from .jaccard import OP6_SQL, op6_jaccard
from .laesa import OP11_SQL, op11_laesa
from .language import op3_language
from .minhash import OP12_SQL, op12_minhash
from .pieces import op9_pieces
from .pii import op10_personal_data
from .resample import OP13_SQL, op13_resample
from .shard import op2_shard
from .substring import OP1_SQL, op1_substring_dedup
from .toxicity import op7_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_shard": op2_shard,
    "op3_language": op3_language,
    "op4_decontaminate": op4_decontaminate,
    "op5_fingerprint": op5_fingerprint,
    "op6_jaccard": op6_jaccard,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_pieces": op9_pieces,
    "op10_personal_data": op10_personal_data,
    "op11_laesa": op11_laesa,
    "op12_minhash": op12_minhash,
    "op13_resample": op13_resample,
}

ORACLE = {
    "op1_substring_dedup": OP1_SQL,
    "op4_decontaminate": OP4_SQL,
    "op6_jaccard": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op11_laesa": OP11_SQL,
    "op12_minhash": OP12_SQL,
    "op13_resample": OP13_SQL,
}
