"""The contract queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.extract import op10_dom_marginals
from cloakframe.llm.hilbert import op7_hilbert_shards, op7_sql
from cloakframe.llm.langid import op1_language_id
from cloakframe.llm.leaks import op9_edit_decontamination
from cloakframe.llm.media import op5_iso_media
from cloakframe.llm.mixing import op6_context_mixing
from cloakframe.llm.packing import op8_tier_packing
from cloakframe.llm.quality import op2_quality
from cloakframe.llm.records import op3_token_records
from cloakframe.llm.simhash import op4_simhash_trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_quality, op3_token_records, op4_simhash_trie, op5_iso_media, op6_context_mixing, op7_hilbert_shards, op8_tier_packing, op9_edit_decontamination, op10_dom_marginals)}


def oracle_sql() -> dict[str, str]:
    return {"op7_hilbert_shards": op7_sql()}
