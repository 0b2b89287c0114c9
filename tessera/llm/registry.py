"""The queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.byte_bpe import op7_byte_bpe
from tessera.llm.hilbert_shards import op9_hilbert_shards
from tessera.llm.language_id import op6_hyperdimensional_lang
from tessera.llm.line_dedup import OP11_SQL, op11_line_dedup
from tessera.llm.media import op5_media
from tessera.llm.minhash import OP4_SQL, op4_minmax_hash
from tessera.llm.ranked_search import OP12_SQL, op12_clustered_search
from tessera.llm.secret_scan import OP8_SQL, op8_secret_scan
from tessera.llm.spelling import OP13_SQL, op13_parity_variants
from tessera.llm.string_tiling import op3_string_tiling
from tessera.llm.style_tree import op2_style_tree
from tessera.llm.suffix_dedup import op10_suffix_dedup
from tessera.llm.url_filter import OP1_SQL, op1_redirect_urls

QUERIES = {
    "op1_redirect_urls": op1_redirect_urls,
    "op2_style_tree": op2_style_tree,
    "op3_string_tiling": op3_string_tiling,
    "op4_minmax_hash": op4_minmax_hash,
    "op5_media": op5_media,
    "op6_hyperdimensional_lang": op6_hyperdimensional_lang,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_hilbert_shards": op9_hilbert_shards,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_clustered_search": op12_clustered_search,
    "op13_parity_variants": op13_parity_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op1_redirect_urls": OP1_SQL,
    "op4_minmax_hash": OP4_SQL,
    "op8_secret_scan": OP8_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_clustered_search": OP12_SQL,
    "op13_parity_variants": OP13_SQL,
}
