"""OP-95: thresholds, weights and scales in one object. Fixed values, but for those given by a caller."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

DEFAULTS: dict[str, dict[str, float]] = {
    "diarization": {"default_threshold": 0.35, "max_clusters": 15, "merge_threshold": 0.25, "close_match_threshold": 0.17, "min_segment_duration": 0.5},
    "matching": {"accept_threshold": 0.35, "clear_winner_gap": 0.02, "embed_only_threshold": 0.16, "confidence_threshold": 0.3, "embed_only_accept_threshold": 0.22},
    "weights": {"embedding": 0.6, "pitch": 0.15, "energy": 0.05, "spectral": 0.1, "mfcc": 0.1},
    "normalization": {
        "pitch_hz_per_unit": 50, "energy_rms_per_unit": 0.05, "spectral_centroid_per_unit": 500, "spectral_rolloff_per_unit": 1000,
        "mfcc0_mean_per_unit": 10, "mfcc0_std_per_unit": 5, "mfcc1_mean_per_unit": 8, "mfcc1_std_per_unit": 4, "mfcc2_mean_per_unit": 6, "mfcc2_std_per_unit": 3,
        **{f"mfcc{k}_{s}_per_unit": v for k in range(3, 13) for s, v in (("mean", 5), ("std", 3))},
        "confidence_max_distance": 0.5,
    },
    "vad": {"default_threshold": 0.5, "min_speech_duration_ms": 250, "chunk_duration": 30, "overlap": 5},
}


class Config:
    """Sections of named values; a caller's mapping overrides single ones."""

    def __init__(self, given: Mapping[str, Mapping[str, Any]] | None = None):
        self.sections = {k: dict(v) for k, v in DEFAULTS.items()}
        for section, values in (given or {}).items():
            self.sections.setdefault(section, {}).update(values)

    def get(self, section: str, key: str | None = None, default: Any = None) -> Any:
        """A value, or without a key the whole section; the default where it isn't there."""
        found = self.sections.get(section)
        if key is None:
            return default if found is None else dict(found)
        return default if found is None else found.get(key, default)
