"""Imports every module of queries, so that the registry is full."""

from . import aggregates, datasets, evidence, flagship, forecast, functions, joins, quality, streams, windows
from .registry import ORACLES, QUERIES

MODULES = (aggregates, datasets, evidence, flagship, forecast, functions, joins, quality, streams, windows)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
