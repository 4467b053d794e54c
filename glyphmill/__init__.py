"""Text quality at scale: normalization, analysis and issue tags of large text tables, as DataFrame expressions."""

from glyphmill.api import Analysis, Normalizer
from glyphmill.functions.register import register

__all__ = ["Analysis", "Normalizer", "register"]
