"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from quillmesh.llm import line_dedup, mixing, quality
from quillmesh.llm.decontaminate import op10_decontaminate
from quillmesh.llm.html_extract import op4_html_extract
from quillmesh.llm.line_dedup import op3_line_dedup
from quillmesh.llm.mixing import op7_mix_sources
from quillmesh.llm.near_dedup import op8_near_dedup
from quillmesh.llm.pii import op1_pii
from quillmesh.llm.quality import op5_quality_rules
from quillmesh.llm.sharding import op6_shard_bins
from quillmesh.llm.toxicity import op9_toxicity
from quillmesh.llm.url_filter import op2_url_filter

QUERIES = {
    "op1_pii": op1_pii,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_quality_rules": op5_quality_rules,
    "op6_shard_bins": op6_shard_bins,
    "op7_mix_sources": op7_mix_sources,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
}
