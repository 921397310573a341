"""Queries and SQL twins of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .chat import OP6_SQL, op6_chat_formatting
from .decontaminate import OP8_SQL, op8_benchmark_decontamination
from .filter_audit import OP11_SQL, op11_filter_audit
from .kneser_ney import op2_quality_perplexity
from .langid import op1_language_id
from .lm import op5_lm_scoring
from .media import op10_media_sniffing
from .mixing import op4_source_mixing
from .neardup import op9_near_duplicates
from .ngram_join import op13_ngram_join
from .packing import op3_token_packing
from .repair import OP12_SQL, op12_conversation_repair
from .warc import OP7_SQL, op7_arc_to_warc

QUERIES = (op1_language_id, op2_quality_perplexity, op3_token_packing, op4_source_mixing, op5_lm_scoring, op6_chat_formatting, op7_arc_to_warc, op8_benchmark_decontamination, op9_near_duplicates, op10_media_sniffing, op11_filter_audit, op12_conversation_repair, op13_ngram_join)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": OP6_SQL, "op7_arc_to_warc": OP7_SQL, "op8_benchmark_decontamination": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_conversation_repair": OP12_SQL}
