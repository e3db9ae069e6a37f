"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigtok.llm.licenses import op1_license_scan
from sigtok.llm.linedup import OP4_SQL, op4_suffix_lines
from sigtok.llm.media import op3_jpeg_thumbnails
from sigtok.llm.neardup import OP2_SQL, op2_bbit_minhash
from sigtok.llm.packing import op9_large_item_packing
from sigtok.llm.pieces import op8_prefix_table
from sigtok.llm.prefixbpe import op11_prefix_bpe
from sigtok.llm.quality import op7_weak_supervision
from sigtok.llm.secretscan import op5_keyword_secrets
from sigtok.llm.sharding import op10_bfd_shards
from sigtok.llm.tokenfile import op6_orc_tokens
from sigtok.llm.whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_bbit_minhash": op2_bbit_minhash,
    "op3_jpeg_thumbnails": op3_jpeg_thumbnails,
    "op4_suffix_lines": op4_suffix_lines,
    "op5_keyword_secrets": op5_keyword_secrets,
    "op6_orc_tokens": op6_orc_tokens,
    "op7_weak_supervision": op7_weak_supervision,
    "op8_prefix_table": op8_prefix_table,
    "op9_large_item_packing": op9_large_item_packing,
    "op10_bfd_shards": op10_bfd_shards,
    "op11_prefix_bpe": op11_prefix_bpe,
    "op12_whitening": op12_whitening,
}

ORACLE_SQL: dict[str, str] = {"op2_bbit_minhash": OP2_SQL, "op4_suffix_lines": OP4_SQL}
