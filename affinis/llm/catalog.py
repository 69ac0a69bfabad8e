"""The subpackage's queries, and the DuckDB SQL of those that SQL can express."""

from affinis.llm.embeddings import op1_embedding_links
from affinis.llm.mixing import OP4_SQL, op4_mix_sources
from affinis.llm.neighbours import op10_nearest
from affinis.llm.packing import op7_best_fit
from affinis.llm.quality import op2_quality
from affinis.llm.simhash import op3_simhash
from affinis.llm.suffix import op8_suffix_dedup
from affinis.llm.token_files import op9_token_files
from affinis.llm.toxicity import op6_toxicity
from affinis.llm.urls import OP5_SQL, op5_url_reputation

QUERIES = {f.__name__: f for f in (op1_embedding_links, op2_quality, op3_simhash, op4_mix_sources, op5_url_reputation, op6_toxicity, op7_best_fit, op8_suffix_dedup, op9_token_files, op10_nearest)}
ORACLES = {"op4_mix_sources": OP4_SQL, "op5_url_reputation": OP5_SQL}
