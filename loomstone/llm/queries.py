"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .balanced_packing import op13_balanced_packing
from .conversations import op11_conversation_repair
from .decontaminate import op7_decontaminate
from .hard_negatives import ORACLE as ORACLE_12
from .hard_negatives import op12_hard_negatives
from .html_text import op6_html_text
from .near_duplicates import op2_near_duplicates
from .packing import op5_packing
from .pii import op3_pii
from .quality_model import op4_quality_model
from .quality_rules import op8_quality_rules
from .secrets import op1_secrets
from .substrings import op9_substrings
from .warc import op10_warc

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_pii": op3_pii,
    "op4_quality_model": op4_quality_model,
    "op5_packing": op5_packing,
    "op6_html_text": op6_html_text,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_substrings": op9_substrings,
    "op10_warc": op10_warc,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_balanced_packing": op13_balanced_packing,
}
ORACLE: dict[str, str] = {"op12_hard_negatives": ORACLE_12}
