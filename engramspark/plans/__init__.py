"""Requests, predicates, planning and execution."""
