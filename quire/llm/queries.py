"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bm25 import OP6_SQL, op6_bm25
from .decontam import OP2_SQL, op2_decontaminate
from .html_crf import op3_html_text
from .jaccard_join import OP7_SQL, op7_jaccard_join
from .licences import OP10_SQL, op10_licences
from .line_dedup import op4_line_dedup
from .mixing import op9_mixing
from .quality import op5_quality
from .quotes import op8_quotes
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_html_text": op3_html_text,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_bm25": op6_bm25,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quotes": op8_quotes,
    "op9_mixing": op9_mixing,
    "op10_licences": op10_licences,
}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op2_decontaminate": OP2_SQL, "op6_bm25": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op10_licences": OP10_SQL}
