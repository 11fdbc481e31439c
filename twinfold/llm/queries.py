"""The queries of this subpackage, and the SQL that DuckDB runs for those that it can express."""

from __future__ import annotations

from twinfold.llm import op2_substrings as op2, op10_jaccard as op10
from twinfold.llm.op1_bpe import op1_bpe
from twinfold.llm.op2_substrings import op2_substrings
from twinfold.llm.op3_decontaminate import op3_decontaminate
from twinfold.llm.op4_pii import op4_pii
from twinfold.llm.op5_toxicity import op5_toxicity
from twinfold.llm.op6_quality import op6_quality
from twinfold.llm.op7_language import op7_language
from twinfold.llm.op8_shards import op8_shards
from twinfold.llm.op9_html import op9_html
from twinfold.llm.op10_jaccard import op10_jaccard

QUERIES = {q.__name__: q for q in (op1_bpe, op2_substrings, op3_decontaminate, op4_pii, op5_toxicity, op6_quality, op7_language, op8_shards, op9_html, op10_jaccard)}
#: The others follow a model or a tokenizer, sketches, CRC sums or page trees, which SQL can't; tests/llm checks them otherwise.
ORACLE_SQL: dict[str, str] = {"op2_substrings": op2.SQL, "op10_jaccard": op10.SQL}
