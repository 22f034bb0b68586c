"""Queries over the provided tables, each beside its SQL formulation."""
