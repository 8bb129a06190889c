"""All registered queries."""

from tickscope.plans import (  # noqa: F401
    function_queries,
    ingest_queries,
    item_queries,
    stream_queries,
    tick_queries,
    trade_queries,
)
from tickscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
