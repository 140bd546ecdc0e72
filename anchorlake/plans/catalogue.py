"""Importing this module registers every query."""

from anchorlake.plans import q_audit, q_flagship, q_master, q_pages, q_sources, q_status, q_stream, q_text, q_urls  # noqa: F401
