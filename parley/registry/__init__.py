"""All registered queries; importing the modules registers them."""

from parley.registry.core import ORACLES, QUERIES
from parley.registry import insight, intake, search, stream  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
