"""Queries by subject; importing this package registers them."""

from . import catalogs, compiling, history, ingest, jobs, markdown, outputs, readmodels, search, streams, validating, web  # noqa: F401
