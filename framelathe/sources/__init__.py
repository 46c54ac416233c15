"""Datasets on disk, file listings, and the frame views that operators work on."""

from .dataset import Dataset, list_files
from .frames import Frames, from_arrays

__all__ = ["Dataset", "Frames", "from_arrays", "list_files"]
