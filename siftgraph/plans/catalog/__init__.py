"""Queries over the test tables, one or more per operator, each beside its SQL form."""

from . import gating, graphs, labelling, storage, vectors  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
