"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op3_ann
from .decontamination import op2_decontamination
from .html_text import op4_html
from .language import op8_language
from .licenses import op10_licenses
from .packing import op9_packing
from .quality import op7_quality
from .simhash import op1_simhash
from .substrings import OP5_SQL, op5_substrings
from .toxicity import op6_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_ann": op3_ann,
    "op4_html": op4_html,
    "op5_substrings": op5_substrings,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL: dict[str, str] = {"op5_substrings": OP5_SQL}
