"""Whole runs: validation of one source, acquisition from a folder, and the pipeline."""

from .acquire import acquire
from .pipeline import TASKS, Job, run_pipeline, run_tasks
from .validate import ingest, run_signal_gates, run_validation

__all__ = ["TASKS", "Job", "acquire", "ingest", "run_pipeline", "run_signal_gates", "run_tasks", "run_validation"]
