"""All registered queries of the analytics operators."""

from __future__ import annotations

from cardloom.plans import cards, catalogue, crawl, deals, decisions, evals, extract, portfolio, quality, spend, streams, text  # noqa: F401  each enters its queries
from cardloom.plans.register import QUERIES, SQL  # noqa: F401
