"""Registered queries with their reference SQL."""

from driftline.catalog import corpus, forecasts, influence, live, quality, series, text, topics, vectors  # noqa: F401
from driftline.catalog.base import ORACLES, QUERIES  # noqa: F401
