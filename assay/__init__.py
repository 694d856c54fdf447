"""Explained first analysis of any Spark table."""

from assay.settings import Settings

__all__ = ["Settings"]
