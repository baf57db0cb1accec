"""The queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.chat import CHAT_SQL, chat_query
from meridian.llm.decontaminate import decontamination_query
from meridian.llm.language_id import language_query
from meridian.llm.licences import licence_query
from meridian.llm.mixing import MIXING_SQL, mixing_query
from meridian.llm.ngram_join import near_duplicates_query
from meridian.llm.oracles import DECONTAMINATION_SQL, NEAR_DUPLICATES_SQL
from meridian.llm.privacy import PRIVACY_SQL, privacy_query
from meridian.llm.quality import quality_query
from meridian.llm.secrets import SECRETS_SQL, secrets_query
from meridian.llm.url_filters import URL_SQL, url_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_query,
    "op2_licence_scans": licence_query,
    "op3_benchmark_decontamination": decontamination_query,
    "op4_personal_data": privacy_query,
    "op5_chat_formatting": chat_query,
    "op6_secret_scans": secrets_query,
    "op7_ngram_jaccard_join": near_duplicates_query,
    "op8_language_id": language_query,
    "op9_quality_rules": quality_query,
    "op10_source_mixing": mixing_query,
}

ORACLES: dict[str, str] = {
    "op1_url_filters": URL_SQL,
    "op3_benchmark_decontamination": DECONTAMINATION_SQL,
    "op4_personal_data": PRIVACY_SQL,
    "op5_chat_formatting": CHAT_SQL,
    "op6_secret_scans": SECRETS_SQL,
    "op7_ngram_jaccard_join": NEAR_DUPLICATES_SQL,
    "op10_source_mixing": MIXING_SQL,
}
