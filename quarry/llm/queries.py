"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.chat import OP9_SQL, op9_chat_formatting
from quarry.llm.decontam import OP6_SQL, op6_benchmark_decontamination
from quarry.llm.langid import op5_language_id
from quarry.llm.media import op4_media_columns
from quarry.llm.packing import op10_best_fit_packing
from quarry.llm.simhash import op1_simhash_near_dedup
from quarry.llm.tokenstore import op7_token_id_store
from quarry.llm.toxicity import op2_toxicity
from quarry.llm.urlfilter import OP3_SQL, op3_url_filters
from quarry.llm.warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_url_filters": op3_url_filters,
    "op4_media_columns": op4_media_columns,
    "op5_language_id": op5_language_id,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_token_id_store": op7_token_id_store,
    "op8_warc": op8_warc,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": OP3_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op9_chat_formatting": OP9_SQL,
}
