"""The operators' queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op4_ann
from .fim import OP11_SQL, op11_fim
from .licenses import OP2_SQL, op2_licenses
from .html_text import OP13_SQL, op13_html
from .lm import op10_lm
from .mixing import OP6_SQL, op6_mixing
from .negatives import OP12_SQL, op12_negatives
from .pieces import op5_sentencepiece
from .quality import OP3_SQL, op3_quality_rules
from .sharding import OP1_SQL, op1_sharding
from .simhash import op8_simhash
from .tokens import op7_tokens
from .toxicity import op9_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_licenses": op2_licenses,
    "op3_quality_rules": op3_quality_rules,
    "op4_ann": op4_ann,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_mixing": op6_mixing,
    "op7_tokens": op7_tokens,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_lm": op10_lm,
    "op11_fim": op11_fim,
    "op12_negatives": op12_negatives,
    "op13_html": op13_html,
}

ORACLE_SQL = {
    "op1_sharding": OP1_SQL,
    "op2_licenses": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op6_mixing": OP6_SQL,
    "op11_fim": OP11_SQL,
    "op12_negatives": OP12_SQL,
    "op13_html": OP13_SQL,
}
