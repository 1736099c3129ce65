"""Thresholds of the detectors and of model post-processing."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    """Seconds, fractions and percent; the defaults are the untuned ones."""

    chunk_sec: int = 600
    apnea_remaining: float = 0.1
    hypopnea_drop: float = 0.3
    min_event_sec: float = 10.0
    noise_floor: float = 1.0
    baseline_half_sec: int = 60
    baseline_share: float = 0.95
    spo2_low: float = 50.0
    spo2_high: float = 100.0
    spo2_fallback: float = 95.0
    spo2_sentinel: float = 127.0
    pulse_sentinel: float = 511.0
    sentinel_tolerance: float = 0.5
    desaturation_drop: float = 3.0
    desaturation_min_sec: float = 2.0
    post_event_sec: float = 30.0
    effort_variance: float = 5.0
    csr_cycles: int = 3
    csr_low_sec: float = 40.0
    csr_high_sec: float = 90.0
    csr_smooth_sec: float = 30.0
    csr_distance_sec: float = 20.0
    snore_ratio: float = 0.5
    snore_crossings: float = 0.3
    snore_rms: float = 2.0
    snore_rms_floor: float = 0.1
    snore_min_sec: float = 1.0
    confidence: float = 0.3
    split_above_sec: float = 120.0
    split_part_sec: float = 60.0
    gate_drop: float = 2.0
    overlap: float = 0.3


DEFAULT = Config()
TUNED = replace(DEFAULT, apnea_remaining=0.6, hypopnea_drop=0.1)
