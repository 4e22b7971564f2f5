"""The registered queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidelog.llm.byte_bpe import op9_tree_bpe
from tidelog.llm.divergence import OP11_SQL, op11_divergence_audit
from tidelog.llm.html_text import op7_block_rules
from tidelog.llm.jaccard import OP4_SQL, op4_ngram_jaccard_join
from tidelog.llm.licenses import op10_license_scan
from tidelog.llm.media import op1_media_sniffing
from tidelog.llm.mixing import OP2_SQL, op2_low_discrepancy_mix
from tidelog.llm.piece_codec import op12_piece_backtracking
from tidelog.llm.pii import op3_pii_sanitisation
from tidelog.llm.quality import OP5_SQL, op5_repetition_coverage
from tidelog.llm.token_counts import op8_token_counts
from tidelog.llm.warc import OP6_SQL, op6_warc_archives
from tidelog.llm.whitening import op13_embedding_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query; each runs over its whole table."""
    return {
        "op1_media_sniffing": op1_media_sniffing,
        "op2_low_discrepancy_mix": op2_low_discrepancy_mix,
        "op3_pii_sanitisation": op3_pii_sanitisation,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_repetition_coverage": op5_repetition_coverage,
        "op6_warc_archives": op6_warc_archives,
        "op7_block_rules": op7_block_rules,
        "op8_token_counts": op8_token_counts,
        "op9_tree_bpe": op9_tree_bpe,
        "op10_license_scan": op10_license_scan,
        "op11_divergence_audit": op11_divergence_audit,
        "op12_piece_backtracking": op12_piece_backtracking,
        "op13_embedding_whitening": op13_embedding_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op2_low_discrepancy_mix": OP2_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op5_repetition_coverage": OP5_SQL, "op6_warc_archives": OP6_SQL, "op11_divergence_audit": OP11_SQL}
