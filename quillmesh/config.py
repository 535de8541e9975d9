"""Settings and schemas.  One frozen object in place of environment variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

NOTE = "id string, title string, tags array<string>, links array<string>, content string, created string, modified string"
CHUNK = "chunk_id string, note_id string, title string, section string, text string, tags array<string>, links array<string>, position int"
HIT = "qid long, rank int, score double, chunk_id string, note_id string, title string, section string, text string"
JUDGEMENT = "correctness double, groundedness double, uses_context boolean, hallucination boolean, short_reason string"
VALIDATION = "query string, relevant_chunk_ids array<string>, relevant_note_ids array<string>, expected_chunk_id string, expected_note_id string"


@dataclass(frozen=True)
class RetrievalConfig:
    k: int = 5
    rrf_k: int = 60
    k1: float = 1.2
    b: float = 0.75
    dim: int = 4096
    overfetch_factor: int = 8
    overfetch_least: int = 40
    tag_boost: float = 0.35
    link_boost: float = 0.10
    link_hits: int = 10
    link_notes: int = 50
    keyword_guard: bool = True
    keyword_penalty: float = 1.0
    keyword_bonus: float = 0.15
    keyword_idf_min: float = 1.5
    keyword_max: int = 8
    diversify: bool = True
    max_per_note: int = 2
    context_chars: int = 12_000
    low_score: float = 0.15
    answer_mode: str = "extractive"
    strategy: str = "exact"
    queries_at_once: int = 2_000

    @property
    def overfetch(self) -> int:
        return max(self.overfetch_factor * max(1, self.k), self.overfetch_least)

    @classmethod
    def from_env(cls, prefix: str = "QUILL_") -> RetrievalConfig:
        """Any field from the environment, e.g. QUILL_RRF_K=30; booleans are 0 or 1."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw != "0" if kind is bool else kind(raw)
        return cls(**found)
