"""Registered queries over the test tables, with their SQL twins."""

from . import catalog, files, graph, quality, review, scalars  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
