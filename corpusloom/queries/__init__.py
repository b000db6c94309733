"""The registered queries over the driver's tables, and their SQL."""

from . import catalogues, corpora, runs, summaries, texts  # noqa: F401  they register
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
