"""Rules that a run's settings must keep, checked before any plan is built."""

from __future__ import annotations

MODES = ("embedding", "gebd", "vlm_qa", "vlm_chunk_selection", "lovr_retrieval")
SCORE_METHODS = ("mean", "gem", "coherence_mean", "lse", "max_sim", "recompute")
CHUNKERS = ("content", "embedding", "surprise")
THRESHOLDS = ("std", "kernel_cpd", "pelt")


def validate(mode: str, chunk_source: str = "stable", chunker: str = "embedding", threshold_method: str = "kernel_cpd", score_method: str = "max_sim", same_encoder: bool = True, selector: str | None = None, preselect: bool = False, best_window: bool = False, query_merge: bool = False, moment_selection: str | None = None, sample_size: int | None = None, resume: bool = False) -> None:
    """Raises ValueError for settings that don't go together."""
    problems = []
    for name, value, known in (("mode", mode, MODES), ("chunker", chunker, CHUNKERS), ("threshold method", threshold_method, THRESHOLDS), ("score method", score_method, SCORE_METHODS)):
        if value not in known:
            problems.append(f"unknown {name} {value}")
    if chunk_source != "stable":
        problems += [f"{what} needs stable chunks" for what, on in (("preselection", preselect), ("best_window", best_window), ("query merge", query_merge), ("a window selector", bool(selector))) if on]
    if moment_selection and mode.startswith("vlm"):
        problems.append("moment selection has no place in this mode")
    if score_method != "recompute" and not same_encoder:
        problems.append("chunk vectors from windows need one encoder for chunking and retrieval")
    if sample_size is not None and sample_size <= 0:
        problems.append("sample_size must be positive")
    if resume and mode == "lovr_retrieval":
        problems.append("gallery retrieval can't be resumed")
    if problems:
        raise ValueError("; ".join(problems))
