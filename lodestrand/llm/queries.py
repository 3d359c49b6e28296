"""The queries of the training-data operators, and the SQL that stands against them where SQL can say the same."""

from __future__ import annotations

from . import chat_format, decontam, near_dedup
from .chat_format import op8_chat_format
from .decontam import op3_decontam
from .fingerprints import op5_fingerprints
from .html_extract import op9_html_extract
from .lang_id import op2_lang_id
from .near_dedup import op4_near_dedup
from .packing import op10_packing
from .secret_scan import op6_secret_scan
from .substring_dedup import op7_substring_dedup
from .token_output import op1_token_output

QUERIES = {f.__name__: f for f in (op1_token_output, op2_lang_id, op3_decontam, op4_near_dedup, op5_fingerprints, op6_secret_scan, op7_substring_dedup, op8_chat_format, op9_html_extract, op10_packing)}
SQL: dict[str, str] = {"op3_decontam": decontam.SQL, "op4_near_dedup": near_dedup.SQL, "op8_chat_format": chat_format.SQL}
