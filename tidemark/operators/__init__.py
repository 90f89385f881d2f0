"""Reusable DataFrame operators: joins, windows, versioned tables, clustering, guards."""
