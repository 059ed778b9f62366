"""The package's queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .fingerprint import op3_fingerprint
from .jaccard import op9_ngram_jaccard
from .licences import op10_licences
from .mixing import OP8_SQL, op8_mixing
from .packing import op5_packing
from .pii import op1_pii
from .substrings import op6_substring_dedup
from .topk import OP2_SQL, op2_topk
from .toxicity import op7_toxicity
from .warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_pii, op2_topk, op3_fingerprint, op4_warc, op5_packing, op6_substring_dedup, op7_toxicity, op8_mixing, op9_ngram_jaccard, op10_licences)}
ORACLE_SQL = {"op2_topk": OP2_SQL, "op4_warc": OP4_SQL, "op8_mixing": OP8_SQL}
