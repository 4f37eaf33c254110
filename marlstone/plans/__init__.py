"""Declarative plans: a universe, panels of metrics, operations.

normalise() reads the many spellings of a plan into one; lower() makes it a
single lazy DataFrame over a catalogue of tables.
"""

from .lower import PlanError, lower
from .normalise import normalise

__all__ = ["PlanError", "lower", "normalise"]
