"""Functions by the engine's names."""

from quarry.functions.library import FUNCTIONS, call

__all__ = ["FUNCTIONS", "call"]
