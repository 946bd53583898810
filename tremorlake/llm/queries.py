"""Every operator of this package as a named query over the given tables."""

from .binary import op10_token_ids
from .counting import op2_token_counts
from .language import op3_language_id
from .manifest import op13_merkle_manifest
from .mixing import op4_mixing
from .oracles import ORACLES
from .packing import op1_best_fit_packing
from .pitman import op11_lm_scoring
from .prefixes import op12_conversation_trie
from .quality import op7_quality_rules
from .search import op6_exact_search
from .sharding import op8_sharding
from .simhash import op5_simhash_dedup
from .toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_token_counts, op3_language_id, op4_mixing, op5_simhash_dedup,
    op6_exact_search, op7_quality_rules, op8_sharding, op9_toxicity, op10_token_ids,
    op11_lm_scoring, op12_conversation_trie, op13_merkle_manifest,
)}

__all__ = ["ORACLES", "QUERIES"]
