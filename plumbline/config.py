"""Settings that define what the engine computes."""

from __future__ import annotations

from dataclasses import dataclass, field

MODES = ("dense", "sparse", "hybrid")


@dataclass(frozen=True)
class Config:
    """The names and defaults say what the measures mean."""

    k: int = 5
    retrieval_mode: str = "hybrid"
    rerank: bool = False
    rerank_candidates: int = 20
    chunk_window: int = 8
    chunk_stride: int = 4
    chunk_min_chars: int = 30
    retrieval_gate: float = 0.30
    abstain_threshold: float = 0.5
    support_threshold: float = 0.5
    weights: dict = field(default_factory=lambda: {"faithfulness": 0.4, "attribution": 0.2, "relevance": 0.2, "conciseness": 0.2})
    seed: int = 0
    answer_relevance: bool = False
    n_questions: int = 3
    contextual: bool = False
    agentic_max_rounds: int = 3
    route_iterate_margin: float = 0.15

    def __post_init__(self) -> None:
        least_one = ("k", "chunk_window", "chunk_stride", "rerank_candidates", "n_questions", "agentic_max_rounds")
        wrong = [n for n in least_one if getattr(self, n) < 1]
        if wrong:
            raise ValueError(f"must be at least 1: {', '.join(wrong)}")
        if self.retrieval_mode not in MODES:
            raise ValueError(f"retrieval_mode is one of {', '.join(MODES)}")
        if any(w <= 0 for w in self.weights.values()):
            raise ValueError("weights are positive")
