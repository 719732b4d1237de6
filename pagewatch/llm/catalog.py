"""One registered query for each operator and the pipeline, and SQL for those that it can express."""

from __future__ import annotations

from corpus_pipeline import run as pipeline
from pagewatch.llm.alignment import op13_tokenizer_alignment
from pagewatch.llm.chat import op12_chat_formatting, op12_sql
from pagewatch.llm.divergence import op11_source_divergence, op11_sql
from pagewatch.llm.fingerprints import op5_fingerprints
from pagewatch.llm.languages import op2_language_id
from pagewatch.llm.licences import op3_licence_scans
from pagewatch.llm.mixing import op6_mixing
from pagewatch.llm.near_duplicates import op8_ngram_jaccard_join
from pagewatch.llm.packing import op10_best_fit_packing
from pagewatch.llm.recompression import op9_substring_dedup
from pagewatch.llm.sharding import op7_sharding, op7_sql
from pagewatch.llm.topk import op4_exact_top_k, op4_sql
from pagewatch.llm.toxicity import op1_toxicity

OPERATORS = (
    op1_toxicity,
    op2_language_id,
    op3_licence_scans,
    op4_exact_top_k,
    op5_fingerprints,
    op6_mixing,
    op7_sharding,
    op8_ngram_jaccard_join,
    op9_substring_dedup,
    op10_best_fit_packing,
    op11_source_divergence,
    op12_chat_formatting,
    op13_tokenizer_alignment,
)
LLM_QUERIES = {**{f.__name__: f for f in OPERATORS}, "pipeline": pipeline}
LLM_ORACLES = {"op4_exact_top_k": op4_sql(), "op7_sharding": op7_sql(), "op11_source_divergence": op11_sql(), "op12_chat_formatting": op12_sql()}
