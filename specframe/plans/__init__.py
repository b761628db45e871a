"""Registered queries with their SQL twins, and multi-stage jobs."""
