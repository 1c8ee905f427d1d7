"""All tunable limits of the matcher in one frozen object.

Fixed values (they must equal the behaviour being reproduced, keep them as is):
  trigram floor 0.3, vector floor 0.3, RRF constant 60, candidates per path 8,
  obvious-match score 0.9, obvious-match gap 0.15, rerank auto confidence 0.8,
  answer timeout 5 minutes, embedding batch 50, structured offers 5,
  organic results read 8, page size default 25, page size cap 100.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class MatchConfig:
    trigram_floor: float = 0.3
    vector_floor: float = 0.3
    rrf_k: int = 60
    top_k: int = 8
    auto_match_score: float = 0.9
    auto_match_gap: float = 0.15
    rerank_auto_confidence: float = 0.8
    ask_timeout_minutes: int = 5
    embed_batch: int = 50
    offer_limit: int = 5
    organic_read: int = 8
    page_default: int = 25
    page_max: int = 100
    default_unit: str = "pcs"
    # unit words the default extraction rule recognises
    unit_words: tuple[str, ...] = ("pcs", "pasang", "rim", "botol", "unit", "box", "kg", "meter")
    # words that, after a bare leading number, mark a measure and not a quantity
    measure_words: tuple[str, ...] = ("inch", "cm", "mm", "gr", "gram", "pk", "gb", "tb", "watt", "w", "a", "v")
    # rows of catalog per block in the blocked similarity joins
    catalog_block_rows: int = 4096
    # query rows per block in the blocked similarity joins
    query_block_rows: int = 2048
    # fixed values: result source -> (label, tone) shown to a reviewer
    status_labels: tuple[tuple[str, str, str], ...] = field(default=(
        ("auto_database", "Cocok otomatis", "ok"),
        ("auto_database_ai", "Dipilih AI", "ok"),
        ("user_selected_db", "Dipilih manual", "manual"),
        ("user_selected_internet", "Dari internet", "manual"),
        ("not_found", "Tidak ditemukan", "bad"),
        ("skipped", "Dilewati", "bad"),
        ("cancelled", "Dibatalkan", "bad"),
        ("error", "Error", "bad"),
        ("unknown", "Tidak diketahui", "bad"),
    ))


DEFAULT = MatchConfig()
