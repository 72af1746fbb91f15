"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from .chat_format import OP10_SQL, op10_chat_format
from .conversation_repair import OP13_SQL, op13_conversation_repair
from .fingerprints import op2_fingerprints
from .html_extract import op1_html_extract
from .jaccard_join import OP9_SQL, op9_jaccard_join
from .mixing import op6_mixing
from .packing import op7_packing
from .periodic_runs import OP12_SQL, op12_periodic_runs
from .secret_scan import op3_secret_scan
from .topk_search import OP5_SQL, op5_topk
from .toxicity import op8_toxicity
from .url_filter import op11_url_filter
from .warc_archive import OP4_SQL, op4_warc

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_fingerprints": op2_fingerprints,
    "op3_secret_scan": op3_secret_scan,
    "op4_warc": op4_warc,
    "op5_topk": op5_topk,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat_format": op10_chat_format,
    "op11_url_filter": op11_url_filter,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL = {"op4_warc": OP4_SQL, "op5_topk": OP5_SQL, "op9_jaccard_join": OP9_SQL, "op10_chat_format": OP10_SQL, "op12_periodic_runs": OP12_SQL, "op13_conversation_repair": OP13_SQL}
