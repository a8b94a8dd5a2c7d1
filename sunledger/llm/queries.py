"""The queries of this subpackage and their SQL."""

from .alignment import op13_token_alignment
from .archives import OP12_SQL, op12_warc
from .conversations import op11_conversation_repair
from .decontamination import OP7_SQL, op7_decontamination
from .langid import op10_language_id
from .lines import OP1_SQL, op1_line_dedup
from .mixing import op5_mix_sources
from .quality import op4_quality
from .secrets import op6_secret_scan
from .simhash import op2_simhash
from .substrings import OP3_SQL, op3_substring_dedup
from .topk import OP8_SQL, op8_exact_topk
from .toxicity import op9_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup, "op2_simhash": op2_simhash,
    "op3_substring_dedup": op3_substring_dedup, "op4_quality": op4_quality, "op5_mix_sources": op5_mix_sources,
    "op6_secret_scan": op6_secret_scan, "op7_decontamination": op7_decontamination,
    "op8_exact_topk": op8_exact_topk, "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id, "op11_conversation_repair": op11_conversation_repair,
    "op12_warc": op12_warc, "op13_token_alignment": op13_token_alignment,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op7_decontamination": OP7_SQL, "op8_exact_topk": OP8_SQL,
           "op12_warc": OP12_SQL}
