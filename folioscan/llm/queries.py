"""The queries of this subpackage, for __spark_entry__.py."""

from folioscan.llm.block_neighbours import OP13_SQL, op13_nearest
from folioscan.llm.bpe import op7_bpe
from folioscan.llm.chat_format import op4_chat_format
from folioscan.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from folioscan.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from folioscan.llm.html_extract import op9_html_text
from folioscan.llm.license_scan import op3_license_scan
from folioscan.llm.mixing import op10_mix_sources
from folioscan.llm.ngram_join import OP8_SQL, op8_ngram_join
from folioscan.llm.pii import op5_pii
from folioscan.llm.spelling import OP11_SQL, op11_spelling_variants
from folioscan.llm.toxicity import op1_toxicity
from folioscan.llm.voronoi_knn import OP6_SQL, op6_topk_search

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_chat_format": op4_chat_format,
    "op5_pii": op5_pii,
    "op6_topk_search": op6_topk_search,
    "op7_bpe": op7_bpe,
    "op8_ngram_join": op8_ngram_join,
    "op9_html_text": op9_html_text,
    "op10_mix_sources": op10_mix_sources,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_nearest": op13_nearest,
}

#: Operators that SQL can't express (models, seeded selection, offsets of matches, merges) are tested against brute force.
ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op6_topk_search": OP6_SQL,
    "op8_ngram_join": OP8_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_nearest": OP13_SQL,
}
