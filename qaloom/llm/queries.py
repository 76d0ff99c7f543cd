"""The queries of this package and their SQL."""

from __future__ import annotations

from .bpe import op8_bpe
from .chat import OP6_SQL, op6_chat_format
from .decontam import OP2_SQL, op2_decontamination
from .langid import op4_language_id
from .line_dedup import OP3_SQL, op3_line_dedup
from .lm_score import op1_lm_score
from .minhash import OP9_SQL, op9_minhash
from .quality_rules import op10_quality_rules
from .secrets import op5_secret_scan
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_chat_format": op6_chat_format,
    "op7_warc": op7_warc,
    "op8_bpe": op8_bpe,
    "op9_minhash": op9_minhash,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES = {
    "op2_decontamination": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op9_minhash": OP9_SQL,
}
