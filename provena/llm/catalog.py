"""Registered queries of the training-data operators: name -> (query, SQL or None)."""

from .bag_search import OP12_SQL, op12_bag_search
from .chat_format import OP6_SQL, op6_chat_format
from .decontaminate import OP3_SQL, op3_decontaminate
from .divergence import OP13_SQL, op13_source_divergence
from .html_extract import op1_html_extract
from .id_store import op11_id_store
from .language_model import op9_language_model
from .near_dedup import op8_near_dedup
from .packing import op4_packing
from .search import OP2_SQL, op2_top_k
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .token_scan import op7_token_scan
from .toxicity import op5_toxicity

QUERIES = {
    "op1_html_extract": (op1_html_extract, None),
    "op2_top_k": (op2_top_k, OP2_SQL),
    "op3_decontaminate": (op3_decontaminate, OP3_SQL),
    "op4_packing": (op4_packing, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_chat_format": (op6_chat_format, OP6_SQL),
    "op7_token_scan": (op7_token_scan, None),
    "op8_near_dedup": (op8_near_dedup, None),
    "op9_language_model": (op9_language_model, None),
    "op10_substring_dedup": (op10_substring_dedup, OP10_SQL),
    "op11_id_store": (op11_id_store, None),
    "op12_bag_search": (op12_bag_search, OP12_SQL),
    "op13_source_divergence": (op13_source_divergence, OP13_SQL),
}
