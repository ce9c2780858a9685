"""The corpus queries by name, and their SQL where SQL can express them."""

from tillscope.llm.alignment import op12_perfect_hash_alignment
from tillscope.llm.chat import OP13_SQL, op13_reply_paths
from tillscope.llm.contamination import op7_edit_matches
from tillscope.llm.credentials import OP9_SQL, op9_credential_links
from tillscope.llm.language import op4_kneser_ney
from tillscope.llm.mixing import op3_entropy_mix
from tillscope.llm.ngram_trie import op5_elias_fano_trie
from tillscope.llm.quality import op10_quality_rules
from tillscope.llm.shards import op1_label_propagation
from tillscope.llm.simhash import op6_simhash_golay
from tillscope.llm.suffixes import op8_sparse_suffixes
from tillscope.llm.token_files import op2_token_files
from tillscope.llm.vantage import OP11_SQL, op11_vantage_tree

QUERIES = {f.__name__: f for f in (
    op1_label_propagation, op2_token_files, op3_entropy_mix, op4_kneser_ney, op5_elias_fano_trie,
    op6_simhash_golay, op7_edit_matches, op8_sparse_suffixes, op9_credential_links, op10_quality_rules,
    op11_vantage_tree, op12_perfect_hash_alignment, op13_reply_paths,
)}

#: The others use learned models, graph steps, file round trips or hashes that SQL lacks; tests compare them with plain Python.
ORACLES: dict[str, str] = {"op9_credential_links": OP9_SQL, "op11_vantage_tree": OP11_SQL, "op13_reply_paths": OP13_SQL}
