"""Schemas, readers, writers, snapshots and table adapters."""
