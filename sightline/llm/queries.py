"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import OP3_SQL, op3_embedding_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .html_text import op8_html_text
from .mixing import op9_mixing
from .ngram_join import OP10_SQL, op10_ngram_join
from .packing import op1_packing
from .pii import op2_pii
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op5_quality_rules
from .sharding import op7_shards
from .token_counts import op4_token_counts
from .token_output import op11_token_output
from .url_filters import op6_url_filters



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py, which lies beside the package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filters": op6_url_filters,
    "op7_shards": op7_shards,
    "op8_html_text": op8_html_text,
    "op9_mixing": op9_mixing,
    "op10_ngram_join": op10_ngram_join,
    "op11_token_output": op11_token_output,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op3_embedding_dedup": OP3_SQL, "op10_ngram_join": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_prefix_trie": OP13_SQL}
