"""Process and evict: units of a source through a raw folder under a byte budget."""

from .evict import resolve_calibration, run_scale
from .runs import run_folder_scale, run_synthetic_scale
from .source import FolderSource, Unit, UnitSource
from .synthetic import synthetic_store, unit_calibration

__all__ = [
    "FolderSource", "Unit", "UnitSource", "resolve_calibration", "run_folder_scale", "run_scale", "run_synthetic_scale", "synthetic_store", "unit_calibration",
]
