"""Per-target scoring parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from dayloom.functions.history_columns import HISTORY_COLUMNS, history_name
from dayloom.vocab import (
    EVENT_DERIVED_FEATURES,
    PRODUCTION_FEATURES,
    SCORE_RANGE,
)


@dataclass(frozen=True)
class TargetSpec:
    """How one target is scored, apart from the fitted model itself."""

    target: str
    model_name: str
    prediction_frame: str
    gamma: float
    features: tuple[str, ...]
    fallback_score: float = 3.0
    score_range: tuple[float, float] | None = SCORE_RANGE
    metrics: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.model_name:
            raise ValueError(f"{self.target}: a model name is needed")
        if self.prediction_frame not in ("absolute", "personal_residual"):
            raise ValueError(f"{self.target}: unknown prediction frame {self.prediction_frame}")
        if not 0.0 <= self.gamma <= 1.0:
            raise ValueError(f"{self.target}: gamma must lie in 0..1")
        if not self.features or len(set(self.features)) != len(self.features):
            raise ValueError(f"{self.target}: features must be unique and not empty")


# --- fixed values: targets of the compact model, in contract order ----------
COMPACT_VERSION = "compact_aw_v2"
COMPACT_NORMALIZATION = "per_user"
COMPACT_TARGETS = (
    TargetSpec("mood_valence", "forest_leaf5", "absolute", 1.0, (
        "history__mood_valence__last",
        "history__mood_valence__mean",
        "history__mood_valence__mean_3",
        "history__mood_valence__std",
        "history__mood_valence__log_count",
        "history__mood_valence__log_gap_hours",
        "history__mood_valence__last_minus_mean",
        "history__dow_sin",
        "history__arousal__mean",
        "history__arousal__last_minus_mean",
        "history__restfulness__last_minus_mean",
        "history__productivity__last",
        "history__productivity__mean",
        "history__productivity__last_minus_mean",
        "history__engagement__mean",
        "history__engagement__last_minus_mean",
        "history__overall_wellbeing__mean",
        "history__overall_wellbeing__last_minus_mean",
        "current60_state_share_2",
        "prior24h_state_share_4",
        "short_fragment_count_2m",
        "current60_state_active_hours",
        "minutes_since_prev1_window",
        "context_24h_ratio_personal_distraction",
        "mean_focus_block_minutes",
        "prior24h_state_share_5",
        "context_7d_ratio_media",
        "current60_state_distance_median",
        "context_7d_ratio_ai_assistant",
        "context_7d_ratio_personal_distraction",
        "input_load",
        "prior24h_state_share_0",
        "context_7d_ratio_research",
    )),
    TargetSpec("arousal", "extra_leaf2", "personal_residual", 1.0, (
        "history__arousal__last",
        "history__arousal__mean",
        "history__arousal__mean_3",
        "history__arousal__std",
        "history__arousal__log_count",
        "history__arousal__log_gap_hours",
        "history__arousal__last_minus_mean",
        "history__hour_sin",
        "history__dow_sin",
        "history__dow_cos",
        "history__mood_valence__mean",
        "history__mood_valence__last_minus_mean",
        "history__restfulness__last",
        "history__restfulness__mean",
        "history__restfulness__last_minus_mean",
        "history__productivity__mean",
        "current60_state_share_4",
        "context_24h_ratio_personal_distraction",
    )),
    TargetSpec("restfulness", "hist_leaf10", "absolute", 1.0, (
        "history__restfulness__last",
        "history__restfulness__mean",
        "history__restfulness__mean_3",
        "history__restfulness__std",
        "history__restfulness__log_gap_hours",
        "history__restfulness__last_minus_mean",
        "history__hour_sin",
        "history__mood_valence__mean",
        "history__mood_valence__last_minus_mean",
        "history__arousal__mean",
        "history__arousal__last_minus_mean",
        "history__stress_management__mean",
        "history__productivity__mean",
        "history__productivity__last_minus_mean",
        "history__engagement__mean",
        "history__engagement__last_minus_mean",
        "history__overall_wellbeing__mean",
        "history__overall_wellbeing__last_minus_mean",
        "current60_state_share_4",
        "prior7d_state_share_5",
    )),
    TargetSpec("stress_management", "hist_leaf20", "absolute", 1.0, (
        "history__stress_management__last",
        "history__stress_management__mean",
        "history__stress_management__mean_3",
        "history__stress_management__log_count",
        "history__stress_management__log_gap_hours",
        "history__hour_sin",
        "history__dow_sin",
        "history__dow_cos",
        "history__arousal__mean",
        "history__restfulness__last",
        "history__restfulness__mean",
        "history__restfulness__last_minus_mean",
        "history__productivity__mean",
        "history__engagement__mean",
        "history__overall_wellbeing__last",
        "history__overall_wellbeing__mean",
        "current60_state_share_4",
        "prior24h_state_share_0",
    )),
    TargetSpec("productivity", "extra_leaf2", "personal_residual", 0.75, (
        "history__productivity__last",
        "history__productivity__mean",
        "history__productivity__mean_3",
        "history__productivity__log_count",
        "history__productivity__log_gap_hours",
        "history__productivity__last_minus_mean",
        "history__hour_sin",
        "history__dow_sin",
        "history__dow_cos",
        "history__mood_valence__last",
        "history__mood_valence__last_minus_mean",
        "history__arousal__last",
        "history__arousal__last_minus_mean",
        "history__restfulness__last",
        "history__restfulness__mean",
        "history__engagement__last",
        "history__engagement__last_minus_mean",
        "history__overall_wellbeing__last",
        "history__overall_wellbeing__mean",
        "history__overall_wellbeing__last_minus_mean",
        "current60_state_share_2",
        "current60_state_share_4",
        "short_fragment_count_2m",
        "current60_state_active_hours",
        "minutes_since_prev1_window",
        "input_active_ratio",
        "mean_focus_block_minutes",
        "current60_state_distance_median",
        "context_7d_ratio_ai_assistant",
        "context_7d_ratio_development",
        "input_load",
        "current_minus_rolling_mean_3_switch_rate",
        "context_7d_ratio_research",
    )),
    TargetSpec("engagement", "hist_leaf10", "absolute", 0.75, (
        "history__engagement__last",
        "history__engagement__mean",
        "history__engagement__mean_3",
        "history__engagement__std",
        "history__engagement__log_count",
        "history__engagement__log_gap_hours",
        "history__engagement__last_minus_mean",
        "current60_state_share_2",
        "current60_state_share_4",
        "short_fragment_count_2m",
        "prior7d_state_share_5",
        "minutes_since_prev1_window",
        "mean_focus_block_minutes",
        "context_7d_ratio_media",
        "current_minus_rolling_mean_3_mean_focus_block_minutes",
        "current60_state_distance_median",
        "context_7d_ratio_ai_assistant",
        "context_7d_ratio_personal_distraction",
        "time_personal_distraction",
        "context_7d_ratio_development",
        "input_load",
        "ratio_communication",
        "current_minus_rolling_mean_3_switch_rate",
        "context_7d_ratio_research",
    )),
    TargetSpec("overall_wellbeing", "forest_leaf5", "absolute", 0.75, (
        "history__overall_wellbeing__last",
        "history__overall_wellbeing__mean",
        "history__overall_wellbeing__mean_3",
        "history__overall_wellbeing__std",
        "history__overall_wellbeing__log_gap_hours",
        "history__overall_wellbeing__last_minus_mean",
        "history__hour_cos",
        "short_fragment_count_2m",
        "minutes_since_prev1_window",
        "context_24h_ratio_personal_distraction",
        "input_active_ratio",
        "mean_focus_block_minutes",
        "context_7d_ratio_personal_distraction",
        "time_personal_distraction",
        "ratio_communication",
        "context_7d_ratio_research",
    )),
)


def check_specs(specs: tuple[TargetSpec, ...]) -> None:
    """Every target knows its own history mean and some event-derived feature."""
    allowed = {*PRODUCTION_FEATURES, *HISTORY_COLUMNS}
    for spec in specs:
        unknown = sorted(set(spec.features) - allowed)
        if unknown:
            raise ValueError(f"{spec.target}: unknown features {unknown}")
        if history_name(spec.target, "mean") not in spec.features:
            raise ValueError(f"{spec.target}: its own history mean is needed")
        if not set(spec.features) & set(EVENT_DERIVED_FEATURES):
            raise ValueError(f"{spec.target}: an event-derived feature is needed")
