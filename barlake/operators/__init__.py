"""Operators: DataFrame in, DataFrame out."""

from . import alignment, estimates, recordings, reports, repmetrics, series, tables, trajectories
from .estimates import VelocitySource, register, source
from .recordings import chain_segments, find_turnarounds, wave_segments
from .repmetrics import compare_panel, rmse_bias, set_summary, theil_sen, velocity_loss
from .trajectories import bilateral_reps, honesty, trajectory_reps

__all__ = [
    "VelocitySource", "alignment", "bilateral_reps", "chain_segments", "compare_panel", "estimates", "find_turnarounds", "honesty", "recordings", "register", "repmetrics",
    "reports", "rmse_bias", "series", "set_summary", "source", "tables", "theil_sen", "trajectories", "trajectory_reps", "velocity_loss", "wave_segments",
]
