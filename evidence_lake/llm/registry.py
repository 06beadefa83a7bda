"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidence_lake.llm.op1_quality import OP1_SQL, op1_quality
from evidence_lake.llm.op2_packing import op2_packing
from evidence_lake.llm.op3_minhash import op3_minhash
from evidence_lake.llm.op4_language import op4_language
from evidence_lake.llm.op5_lines import op5_lines
from evidence_lake.llm.op6_substring import op6_substring, substring_repeats_inside
from evidence_lake.llm.op7_html import op7_html
from evidence_lake.llm.op8_topk import OP8_SQL, op8_topk
from evidence_lake.llm.op9_mixing import op9_mixing
from evidence_lake.llm.op10_token_file import op10_token_file
from evidence_lake.llm.op11_lexical import OP11_SQL, op11_lexical
from evidence_lake.llm.op12_neighbours import OP12_SQL, op12_neighbours
from evidence_lake.llm.op13_whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_minhash": op3_minhash,
    "op4_language": op4_language,
    "op5_lines": op5_lines,
    "op6_substring": op6_substring,
    "op7_html": op7_html,
    "op8_topk": op8_topk,
    "op9_mixing": op9_mixing,
    "op10_token_file": op10_token_file,
    "op11_lexical": op11_lexical,
    "op12_neighbours": op12_neighbours,
    "op13_whitening": op13_whitening,
    "substring_repeats_inside": substring_repeats_inside,
}
ORACLE_SQL: dict[str, str] = {"op1_quality": OP1_SQL, "op8_topk": OP8_SQL, "op11_lexical": OP11_SQL, "op12_neighbours": OP12_SQL}
