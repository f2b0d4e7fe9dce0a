"""All registered queries and their SQL."""

from tidemark.plans import core, metrics, models, reports, text  # noqa: F401  each adds its queries

QUERIES = core.QUERIES
ORACLE = core.ORACLE
