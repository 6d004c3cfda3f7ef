"""All queries over the reference's own operators, with their SQL."""

from __future__ import annotations

from . import corporate, estimates, fact_queries, fulltext, gaps, links, peers, prices, ratios, relations, research, screens, stated, stepwise, streams, texts  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401

FLAGSHIP = "rolling_indicators"
