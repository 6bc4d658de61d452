"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import sql
from .alignment import op12_alignment
from .decontaminate import op1_decontaminate
from .html_text import op7_html_text
from .language_id import op11_language_id
from .lexical import op13_lexical
from .ordinal import op5_ordinal
from .packing import op9_packing
from .quality_rules import op3_quality_rules
from .secrets import op6_secrets
from .simhash import op10_simhash
from .token_counts import op4_token_counts
from .toxicity import op2_toxicity
from .warc import op8_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_ordinal": op5_ordinal,
    "op6_secrets": op6_secrets,
    "op7_html_text": op7_html_text,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_language_id": op11_language_id,
    "op12_alignment": op12_alignment,
    "op13_lexical": op13_lexical,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": sql.QUALITY_RULES,
    "op8_warc": sql.WARC,
    "op13_lexical": sql.LEXICAL,
}
