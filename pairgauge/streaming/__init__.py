"""Structured Streaming over append-only logs."""

from .logs import best_so_far, budget_alerts, progress, replay, scan_progress, tail, windowed

__all__ = ["best_so_far", "budget_alerts", "progress", "replay", "scan_progress", "tail", "windowed"]
