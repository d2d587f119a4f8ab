"""All registered queries, by area."""

from etholith.plans import archives, frames, relational, roundtrips, scalars, statistics, streams, trackqueries  # noqa: F401
from etholith.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
