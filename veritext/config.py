"""Settings and fixed values of the scoring protocol. Every operator takes its settings as an argument."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: weights, limits and cut-offs of the protocol ---
FINAL_WEIGHTS = {"table": 0.40, "title_layout": 0.20, "text": 0.40}
TITLE_WEIGHTS = {"heading_f1": 0.80, "level_accuracy": 0.10, "order": 0.10}
EXACT_BODY_CELLS = 4_000_000
EXACT_TABLE_CELLS = 200_000
EXACT_BLOCK_CELLS = 4_000_000
ORDERED_CANDIDATES = 5
RETRIEVED_CANDIDATES = 6
RETRIEVAL_WEIGHTS = {"keyword": 0.70, "structure": 0.30}
EDGE_WEIGHTS = {"keyword": 0.50, "pair": 0.30, "structure": 0.20}
LEAST_MATCH, LEAST_KEYWORD, LEAST_PAIR = 32.0, 8.0, 75.0
KEYWORD_WEIGHTS = {"word": 0.35, "bigram": 0.65}
HEADING_GAP, HEADING_UNLIKE, HEADING_LEAST = 1.0, 1.10, 0.20
ANCHOR_ROWS, ANCHOR_CHARS = 3, 6000
PREVIEW_CHARS, HEADING_PREVIEW_CHARS, CROSS_PAGE_LOOKBACK = 140, 80, 500
REPORT_OPS, REPORT_MATCHES, REPORT_EXAMPLES, REPORT_LEVELS = 100, 30, 20, 120
DIGITS = 4


@dataclass(frozen=True)
class ScoringConfig:
    """normalize_zh is `t2s` (with the character map of `variants`) or `none`."""

    normalize_images: bool = True
    normalize_footnotes: bool = True
    normalize_punctuation: bool = True
    remove_pred_header_footer: bool = False
    normalize_zh: str = "t2s"
    table_structure_weight: float = 0.60
    table_content_weight: float = 0.40
    variants: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.normalize_zh not in ("t2s", "none"):
            raise ValueError(f"normalize_zh is {self.normalize_zh!r}")
        if min(self.table_structure_weight, self.table_content_weight) < 0 or self.table_structure_weight + self.table_content_weight <= 0:
            raise ValueError("table weights must not be negative, and their sum must be positive")

    @property
    def structure_share(self) -> float:
        return self.table_structure_weight / max(self.table_structure_weight + self.table_content_weight, 1e-9)

    @property
    def content_share(self) -> float:
        return self.table_content_weight / max(self.table_structure_weight + self.table_content_weight, 1e-9)
