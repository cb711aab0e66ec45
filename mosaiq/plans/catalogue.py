"""All queries by name and their DuckDB twins: importing the modules registers them."""

from mosaiq.plans import batches, curation, files, fusion, metrics, records, reports, sessions, streams, texts  # noqa: F401
from mosaiq.plans.registry import ORACLES, QUERIES  # noqa: F401
