"""Importing this module registers every query."""

from . import q_functions, q_places, q_plans, q_questions, q_reports, q_search, q_sources, q_tables, q_timeline  # noqa: F401
