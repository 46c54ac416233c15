"""The query catalogue: every operator applied to the driver's tables, with its SQL."""

from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
