"""Column expressions: rounding, robust z-scores, paths, templates and JSON."""

from .numeric import finite_or_zero, half_even, half_even_int, list_score, nan_if_null, ratio, robust_z, row_score
from .text import chunk_and_file, path_class, python_float, render_template, suffix_after_dash, unit_id

__all__ = [
    "chunk_and_file", "finite_or_zero", "half_even", "half_even_int", "list_score", "nan_if_null", "path_class", "python_float", "ratio",
    "render_template", "robust_z", "row_score", "suffix_after_dash", "unit_id",
]
