"""Reduction of large collections of log lines to a small, representative sample, on Spark."""

from .config import Level, Mode, OutputFormat, Settings, preset
from .engine import Reducer, Reduction
from .errors import SamplingNotSupported, SourceError
from .plans.target import collect_target

__version__ = "0.1.0"
__all__ = ["Level", "Mode", "OutputFormat", "Reducer", "Reduction", "SamplingNotSupported", "Settings", "SourceError", "collect_target", "preset", "__version__"]
