"""The queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sceneql.llm import op04_substrings, op05_mixing, op09_minhash, op11_resampling, op12_variants, op13_exact_top_k
from sceneql.llm.op01_language import op1_language
from sceneql.llm.op02_tiff import op2_tiff
from sceneql.llm.op03_toxicity import op3_toxicity
from sceneql.llm.op04_substrings import op4_substrings
from sceneql.llm.op05_mixing import op5_mixing
from sceneql.llm.op06_pitman_yor import op6_pitman_yor
from sceneql.llm.op07_html import op7_html
from sceneql.llm.op08_packing import op8_packing
from sceneql.llm.op09_minhash import op9_minhash
from sceneql.llm.op10_order_minhash import op10_order_minhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_language, op2_tiff, op3_toxicity, op4_substrings, op5_mixing, op6_pitman_yor, op7_html, op8_packing, op9_minhash, op10_order_minhash, op11_resampling.op11_resampling, op12_variants.op12_variants, op13_exact_top_k.op13_exact_top_k)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_substrings": op04_substrings.SQL, "op5_mixing": op05_mixing.SQL, "op9_minhash": op09_minhash.SQL, "op11_resampling": op11_resampling.SQL, "op12_variants": op12_variants.SQL, "op13_exact_top_k": op13_exact_top_k.SQL}
