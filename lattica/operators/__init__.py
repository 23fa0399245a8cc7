"""Operators; importing any of them gives arrays all their methods."""

from . import array, binning, coords  # noqa: F401
