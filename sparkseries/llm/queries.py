"""The numbered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from .html import op6_html
from .language import op5_language
from .lines import OP11_SQL, op11_lines
from .media import op7_media
from .mixing import OP3_SQL, op3_mixing
from .neardup import OP10_SQL, op10_neardup
from .negatives import OP12_SQL, op12_negatives
from .packing import op1_packing
from .periods import OP13_SQL, op13_periods
from .search import OP9_SQL, op9_search
from .sharding import op8_shards
from .suffix import op2_suffix
from .toxicity import op4_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffix": op2_suffix,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_html": op6_html,
    "op7_media": op7_media,
    "op8_shards": op8_shards,
    "op9_search": op9_search,
    "op10_neardup": op10_neardup,
    "op11_lines": op11_lines,
    "op12_negatives": op12_negatives,
    "op13_periods": op13_periods,
}

SQL = {"op3_mixing": OP3_SQL, "op9_search": OP9_SQL, "op10_neardup": OP10_SQL, "op11_lines": OP11_SQL, "op12_negatives": OP12_SQL, "op13_periods": OP13_SQL}
