"""The queries of this folder, by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from quire.llm.centroids import OP12_SQL, op12_centroid_clustering
from quire.llm.decontaminate import op8_benchmark_decontamination
from quire.llm.embedding_dedup import op10_embedding_near_duplicates
from quire.llm.fill_middle import OP11_SQL, op11_fill_in_middle
from quire.llm.line_dedup import OP3_SQL, op3_line_dedup
from quire.llm.lm_score import op4_lm_scoring
from quire.llm.packing import op6_best_fit_packing
from quire.llm.simhash import op2_simhash_near_duplicates
from quire.llm.substring_dedup import OP13_SQL, op13_substring_dedup
from quire.llm.token_files import op9_wavelet_token_files
from quire.llm.toxicity import op1_toxicity
from quire.llm.url_filter import OP7_SQL, op7_url_filters
from quire.llm.warc import op5_warc_derivatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_simhash_near_duplicates,
        op3_line_dedup,
        op4_lm_scoring,
        op5_warc_derivatives,
        op6_best_fit_packing,
        op7_url_filters,
        op8_benchmark_decontamination,
        op9_wavelet_token_files,
        op10_embedding_near_duplicates,
        op11_fill_in_middle,
        op12_centroid_clustering,
        op13_substring_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op7_url_filters": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op12_centroid_clustering": OP12_SQL, "op13_substring_dedup": OP13_SQL}
