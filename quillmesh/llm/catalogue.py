"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm.asof import OP12_SQL, op12_asof_join
from quillmesh.llm.collocations import OP13_SQL, op13_phrase_collocations
from quillmesh.llm.language import op1_language_id
from quillmesh.llm.licenses import BASE_SQL, license_base_places, op11_license_scan
from quillmesh.llm.media import op7_media_columns
from quillmesh.llm.mixing import op4_pivotal_mixing
from quillmesh.llm.ngram_join import OP6_SQL, op6_ngram_jaccard
from quillmesh.llm.packing import op8_bin_completion
from quillmesh.llm.sharding import op9_lookup_sharding, op9_sql
from quillmesh.llm.suffix_dedup import OP10_SQL, op10_suffix_dedup
from quillmesh.llm.topk import OP5_SQL, op5_exact_topk
from quillmesh.llm.toxicity import op3_string_kernel_toxicity
from quillmesh.llm.urls import op2_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_string_kernel_toxicity, op4_pivotal_mixing, op5_exact_topk, op6_ngram_jaccard, op7_media_columns, op8_bin_completion, op9_lookup_sharding, op10_suffix_dedup, op11_license_scan, op12_asof_join, op13_phrase_collocations, license_base_places)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk": OP5_SQL, "op6_ngram_jaccard": OP6_SQL, "op9_lookup_sharding": op9_sql(), "op10_suffix_dedup": OP10_SQL, "license_base_places": BASE_SQL, "op12_asof_join": OP12_SQL, "op13_phrase_collocations": OP13_SQL}
