"""Registers every query."""

from . import evidence, planning, ranking, research, results, scan, settings, state, stored  # noqa: F401
