"""Queries of this subpackage and their SQL."""

from . import chat, decontaminate, lines, mixing, phrases, topk
from .chat import op8_chat
from .decontaminate import op1_decontaminate
from .lines import op13_line_dedup
from .mixing import op5_mix_sources
from .neardup import op6_simhash
from .periodic import op11_periodic_runs
from .phrases import op12_collocations
from .pii import op10_personal_data
from .quality import op2_quality
from .tokens import op7_token_output
from .topk import op9_top_k
from .toxicity import op3_toxicity
from .urls import op4_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_quality, op3_toxicity, op4_url_filter, op5_mix_sources,
        op6_simhash, op7_token_output, op8_chat, op9_top_k, op10_personal_data,
        op11_periodic_runs, op12_collocations, op13_line_dedup,
    )
}

#: Queries that SQL can express; op9's joins every query with every vector, so it suits tables of the test sizes.
ORACLE_SQL = {"op1_decontaminate": decontaminate.ORACLE, "op8_chat": chat.ORACLE, "op5_mix_sources": mixing.ORACLE, "op9_top_k": topk.ORACLE,
              "op12_collocations": phrases.ORACLE, "op13_line_dedup": lines.ORACLE}
