"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from cytoframe.llm.exact_search import OP1_SQL, op1_exact_top_k
from cytoframe.llm.graph_search import op4_graph_search
from cytoframe.llm.html_text import op7_html_extraction
from cytoframe.llm.mixing import op9_mixing
from cytoframe.llm.near_duplicates import op10_minhash
from cytoframe.llm.packing import op5_packing
from cytoframe.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from cytoframe.llm.reply_trees import OP12_SQL, op12_chat_formatting
from cytoframe.llm.structure_repair import OP13_SQL, op13_structure_repair
from cytoframe.llm.suffix_dedup import op8_suffix_array
from cytoframe.llm.token_counts import op3_token_counts
from cytoframe.llm.toxicity import op2_toxicity
from cytoframe.llm.unit_dedup import OP6_SQL, op6_passage_dedup, op6_unit_dedup

QUERIES: dict[str, Callable] = {
    f.__name__: f
    for f in (
        op1_exact_top_k, op2_toxicity, op3_token_counts, op4_graph_search, op5_packing, op6_unit_dedup,
        op6_passage_dedup, op7_html_extraction, op8_suffix_array, op9_mixing, op10_minhash,
        op11_prefix_trie, op12_chat_formatting, op13_structure_repair,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
SQL: dict[str, str] = {
    "op1_exact_top_k": OP1_SQL, "op6_unit_dedup": OP6_SQL, "op11_prefix_trie": OP11_SQL,
    "op12_chat_formatting": OP12_SQL, "op13_structure_repair": OP13_SQL,
}
