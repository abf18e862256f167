"""The registered queries over the driver's tables and their SQL oracles."""

from strandlog.catalogue import functions, graphs, kv, queueing, replicas, streams  # noqa: F401
from strandlog.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
