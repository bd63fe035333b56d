"""Every numeric threshold of the verdict rules in one record, so that each can be changed for a sensitivity run."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


# Thresholds that results depend on. Times are seconds unless the name says otherwise.
@dataclass(frozen=True)
class Params:
    min_gap: float = 20.0
    edge: float = 120.0
    edge_share: float = 0.10
    step_min: float = 5.0
    step_rate: float = 0.30
    run_k: int = 6
    run_dev: float = 2.0
    run_mad: float = 0.5
    offset_k: int = 10
    offset_dev: float = 1.2
    cluster_dev: float = 2.5
    cluster_single: float = 5.0
    cluster_window: float = 300.0
    window_gap: float = 20.0
    window_span: float = 240.0
    silence_pad: float = 0.2
    silence_min: float = 0.3
    loop_min: int = 5
    anchor_overlap: float = 0.5
    anchor_shared: int = 2
    anchor_min: int = 3
    anchor_mad: float = 1.0
    fit_resid: float = 1.5
    fit_keep: float = 2.5
    fit_floor: int = 8
    fit_rounds: int = 3
    flat: float = 0.25
    overrun_slack: float = 1.0
    share_off_points: int = 40
    min_cue: float = 0.5
    probe_clip: float = 30.0
    missing_seconds: float = 15.0
    missing_words: int = 100
    missing_words_small: int = 50
    swap_rate: float = 0.10
    swap_min: int = 5
    swap_checked: int = 10
    swap_window: float = 90.0
    swap_overlap: float = 0.5
    onset_reach: float = 2.0
    onset_trim: float = 1.5
    onset_points: int = 40
    onset_stride: int = 3
    signature_points: int = 20
    signature_trim: float = 8.0
    signature_bins: int = 16
    signature_votes: int = 8
    signature_parts: int = 8
    signature_tilt: float = 0.90
    signature_binned: float = 0.90
    signature_left_out: float = 0.70
    rate_snap: float = 0.0008
    rate_snap_gate: float = 0.0003
    rate_snap_slack: float = 0.02
    rate_most: float = 0.08
    rate_keep: float = 0.85
    region_tolerance: float = 2.5
    region_least: int = 3
    resync_least: float = 1.0
    witness_window: float = 60.0
    witness_reach: float = 30.0
    witness_step: float = 0.1
    witness_cues: int = 6
    min_change: float = 0.25
    quarter_most: float = 1.5
    drift_spread: float = 1.0
    drift_onset: float = 0.30
    condemn_shift: float = 2.5
    condemn_dense: int = 3
    condemn_sparse: int = 2
    condemn_lone: float = 10.0
    condemn_spread: float = 20.0
    overlap_least: float = 0.25
    offset_points: int = 40
    offset_resid: float = 0.40
    offset_least: float = 0.75
    offset_after: float = 0.5
    offset_cover: float = 0.6
    run_reach: float = 180.0
    run_repair_most: float = 30.0
    short_run_k: int = 3
    short_run_dev: float = 5.0
    short_run_mad: float = 1.0

    def scaled(self, name: str, factor: float) -> Params:
        """A copy with one threshold multiplied."""
        kind = {f.name: type(getattr(self, f.name)) for f in fields(self)}[name]
        return replace(self, **{name: kind(getattr(self, name) * factor)})


DEFAULTS = Params()
# Conversion ratios between frame rates that occur in practice, and their names.
RATE_RATIOS = (1000 / 1001, 1001 / 1000, 24 / 25, 25 / 24, 24000 / 1001 / 25, 25 / (24000 / 1001))
RATE_NAMES = ("24/23.976", "23.976/24", "25/24", "24/25", "25/23.976", "23.976/25")
