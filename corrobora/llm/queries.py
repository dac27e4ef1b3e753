"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from corrobora.llm.byte_bpe import bpe_query
from corrobora.llm.embedding_links import LINKS_SQL, links_query
from corrobora.llm.fingerprints import fingerprints_query
from corrobora.llm.hard_negatives import NEGATIVES_SQL, negatives_query
from corrobora.llm.licences import licences_query
from corrobora.llm.line_dedup import lines_query
from corrobora.llm.near_dedup import near_query
from corrobora.llm.packing import packing_query
from corrobora.llm.quality_classifier import quality_query
from corrobora.llm.quality_rules import rules_query
from corrobora.llm.token_alignment import alignment_query
from corrobora.llm.token_shards import shards_query
from corrobora.llm.warc import derivatives_query

QUERIES = {
    "op1_quality_classifier": quality_query,
    "op2_byte_bpe": bpe_query,
    "op3_token_shards": shards_query,
    "op4_fingerprints": fingerprints_query,
    "op5_licences": licences_query,
    "op6_line_dedup": lines_query,
    "op7_quality_rules": rules_query,
    "op8_warc_derivatives": derivatives_query,
    "op9_packing": packing_query,
    "op10_simhash_near_dedup": near_query,
    "op11_token_alignment": alignment_query,
    "op12_hard_negatives": negatives_query,
    "op13_embedding_links": links_query,
}

SQL: dict[str, str] = {"op12_hard_negatives": NEGATIVES_SQL, "op13_embedding_links": LINKS_SQL}
