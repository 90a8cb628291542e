"""Operators put together: matching from records to guarded clusters, and one deployment's pipeline."""
