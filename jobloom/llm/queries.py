"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op11
from .decontaminate import op8
from .fill_middle import op13
from .fingerprint import op9
from .line_dedup import op6
from .lm_score import op2
from .packing import op3
from .pii import op4
from .repeats import op1
from .runs import op12
from .similar import op5
from .toxicity import op10
from .warc import OP7_SQL, op7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_bytes": op1,
    "op2_lm_score": op2,
    "op3_pack_documents": op3,
    "op4_personal_data": op4,
    "op5_jaccard_join": op5,
    "op6_line_dedup": op6,
    "op7_warc_round_trip": op7,
    "op8_decontaminate": op8,
    "op9_fingerprint": op9,
    "op10_toxicity": op10,
    "op11_bpe_round_trip": op11,
    "op12_periodic_runs": op12,
    "op13_fill_middle": op13,
}

ORACLE: dict[str, str] = {"op7_warc_round_trip": OP7_SQL}
